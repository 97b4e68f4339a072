"""Best-fit packing of token sequences, in bulk rounds over length classes.

Lengths are whole numbers up to the capacity, so however many documents there are, they form at most
`capacity` classes of equal length, and open sequences form classes of equal gap. Spark counts and ranks
documents; rounds run from the longest class to the shortest. A round sweeps the gap classes upwards from
the successor of the length: the documents of the class fill the smallest fitting gaps first, as many to a
gap as fit, in the order of their ranks; filled gaps move to the class of what is left; what finds no gap
opens new sequences. This is best-fit decreasing exactly, and what a round needs is bounded by the
capacity, not by the data. Each document then looks up its place by (length, rank) in the plan, in parallel.

Only documents longer than the capacity are cut, into pieces of the capacity and a rest.

NULL texts count as empty; an empty document is the separator alone. Documents with NULL or repeated ids are
packed like others. Ties in length are broken by doc_id and piece. An empty table gives an empty result. Only
doc_id and text are read, other columns have no influence.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from holdfast.llm.tables import map_batches, store, text_slices

CAPACITY = 4096
SEPARATOR = 1
ROWS_PER_SALT = 500_000


TAIL = ".,;:!?*#$%&|"  # ASCII signs that the tokenizer parts from letters before them


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in a byte-level vocabulary: printable bytes themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of texts under the lower-casing word tokenizer, which never joins across ASCII white space.

    Ids of words are remembered. An unseen word of letters up to U+00FF goes to the model directly, spelt in
    byte letters; any other takes the whole way of normalizing and splitting. Signs at the end of a word are
    looked up apart from it, as the tokenizer splits there; only such words are also kept without their signs.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered, self.known, self.stems = remembered, {}, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def _made(self, stem: str) -> bytes:
        if stem.isascii() and stem.isalpha():
            ids = [t.id for t in self.model.tokenize(stem.lower())]
        elif stem.isalpha() and max(stem) <= "\xff":
            ids = [t.id for t in self.model.tokenize(stem.lower().encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(stem, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stem(self, stem: str) -> bytes:
        if (found := self.stems.get(stem)) is None:
            found = self.stems[stem] = self._made(stem)
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        stem = text.rstrip(TAIL)
        if stem != text and stem.isalpha():
            return self._stem(stem) + self._stem(text[len(stem) :])
        return self.stems.get(text) or self._made(text)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [(text or "").encode().split() for text in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        if len(self.stems) > self.remembered:
            self.stems.clear()
        for word in set().union(*parts) - self.known.keys():
            self.known[word] = self._word(word)
        return [b"".join([self.known[w] for w in words]) for words in parts]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    end = int(separator).to_bytes(4, "little")

    def run(batch: pa.RecordBatch):
        tokenizer = _tokenizer(tokenizer_path)
        for part in text_slices(batch):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenizer.ids(part.column("text").to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = zip(*rows)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rounds over the length classes; rows (length, first rank, per sequence, first sequence, offset of the first)."""
    gaps: list[int] = []  # sizes of the open gaps, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences that have it, as (first, how many)
    rows, opened = [], 0

    def put_back(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, many = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            each = min(gap // length, left)
            used = min(many, left // each)
            rows.append((length, rank, each, first, capacity - gap))
            put_back(gap - each * length, first, used)
            put_back(gap, first + used, many - used)
            rank, left = rank + used * each, left - used * each
    return np.array(rows, np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Adds `rank`, 0, 1, ... among pieces of equal length; a frequent length is numbered in `salts` parts."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    starts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    ).drop("_n")
    numbered = salted.withColumn(
        "_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    )
    return numbered.join(starts, ["length", "_salt"]).withColumn(
        "rank", F.col("_before") + F.col("_row") - 1
    ).drop("_salt", "_row", "_before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset; pieces must be a stored table, as it is read more than once."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(counts, capacity)
    keys = rows[:, 0] << 40 | rows[:, 1]
    order = np.argsort(keys)
    rows, keys = rows[order], keys[order]

    def run(batch: pa.RecordBatch):
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        own = rows[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
        nth = rank - own[:, 1]
        sequence, offset = own[:, 3] + nth // own[:, 2], own[:, 4] + nth % own[:, 2] * length
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
        )

    salts = max(16, sum(counts.values()) // ROWS_PER_SALT)
    return map_batches(
        ranked(pieces, salts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), run,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )


def best_fit(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    return pack(store(token_pieces(docs, tokenizer_path, capacity, separator), "pieces"), capacity)
