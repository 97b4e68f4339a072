"""Removal of lines that several documents share.

Texts are split at \\n and every line is exploded under the hash of its key: the line without the white space
`[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case. Keys of enough code points are counted per hash by the distinct documents
that hold them; a key at the threshold loses all its lines except in the document with the smallest id that holds it. The
places of lost lines are gathered per document and the other lines are joined again in their order.

What moves: one small row per distinct key and task for the count (a line in very many documents arrives once per task), one
per line for the look-up, whose hot keys are left to adaptive skew handling, and each row once to meet the places it loses.
Keys are compared by two independent 64-bit hashes: with 10^12 different lines a false match has a chance of about 10^-15.

NULL texts count as empty, and an empty text is one empty line. A document is an id: rows with equal ids are one document and
never lose lines to each other. Rows with a NULL id keep everything and count for nothing. Repeated rows are treated alike.
An empty table gives an empty result. Other columns are carried along, whatever they are called. A document that loses all its
lines stays with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.llm.tables import store

LEAST_CHARS, LEAST_DOCS = 10, 2
WHITE_SPACE = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW = ["doc", "text_hash"]  # rows with equal values lose the same places


def line_key(line: Column) -> Column:
    """Stripped, and lower-cased in A-Z alone: the general lower() is the same thing only for ASCII."""
    bare = F.btrim(line, F.lit(WHITE_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, CAPITALS, CAPITALS.lower()))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    id_ = F.col("doc_id").cast("bigint")
    return docs.select(id_.alias("doc"), F.xxhash64("doc_id", text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"), F.struct(*others).alias("others"))


def _hashed_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """doc, text_hash, place and the two hashes of every line that can be lost."""
    lines = rows.filter("doc IS NOT NULL").select(*ROW, F.posexplode("lines").alias("place", "line"))
    keys = lines.select(*ROW, "place", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    return keys.select(*ROW, "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def shared_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """Hashes that enough distinct documents hold, and the smallest of these documents."""
    groups = lines.groupBy("h1", "h2")
    if least_docs == 2:  # two distinct ids are there exactly if the smallest isn't the largest
        return groups.agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("h1", "h2", "first")
    counted = groups.agg(F.min("doc").alias("first"), F.count_distinct("doc").alias("n"))
    return counted.filter(F.col("n") >= least_docs).select("h1", "h2", "first")


def _without_shared(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """others, lines, and kept: the places that stay in rising order, NULL where none is lost."""
    rows = _rows(docs)
    lines = _hashed_lines(rows, least_chars)
    # Both small sides are written first: their size is then known, and hot keys of the other side can be split.
    shared = store(shared_keys(lines, least_docs), "shared-lines")
    lost = lines.join(shared, ["h1", "h2"]).filter("doc > first")
    places = store(lost.groupBy(*ROW).agg(F.collect_set("place").alias("lost")), "lost-lines")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    return rows.join(places, ROW, "left").withColumn("kept", F.when(F.col("lost").isNotNull(), F.array_except(every, F.col("lost"))))


def _kept_text() -> Column:
    left = F.transform("kept", lambda place: F.get(F.col("lines"), place))
    return F.array_join(F.coalesce(left, F.col("lines")), "\n")


def cleaned(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Rows of docs with the text that is left."""
    found = _without_shared(docs, least_chars, least_docs).withColumn("left_text", _kept_text())
    return found.select(*(F.col("left_text").alias(c) if c == "text" else F.col(f"others.`{c}`").alias(c) for c in docs.columns))


def digest(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Per row: lines before and lost, SHA-256 of the text that is left."""
    found = _without_shared(docs.select("doc_id", "text"), least_chars, least_docs)
    n = F.size("lines").cast("bigint")
    return found.select(
        F.col("others.doc_id").alias("doc_id"), n.alias("n_lines"),
        F.coalesce(n - F.size("kept"), F.lit(0)).cast("bigint").alias("n_dropped"), F.sha2(_kept_text(), 256).alias("kept_sha256"),
    )
