"""How far the sources of a language differ in the words they use, from count-level bitmaps.

Terms are runs of ASCII letters and of any non-ASCII characters, A-Z in lower case. A language keeps the terms that enough of its
documents hold. A group is a (language, source) that occurs; it gives each kept term p = 1 + floor(SCALE * (count + PRIOR) /
(N + PRIOR * V)), so p depends on the term only through its count. Two groups differ by the sum of |p - q| over all kept terms.

1. Tasks count terms per group and write sums; terms with their totals come out of one window over (language, term),
   which holds a row per source at most.
2. Kept terms get a place: a 64-bit word and a bit. Terms of similar frequency share a word, so a word has few count levels.
   A group's bitmap of one count is its terms' bits, or-ed; words without a bit are not stored.
3. In a word, bitmap AND bitmap and a count of the bits gives how many terms have count i here and j there: the joint cell.
   Cells with a zero count are not stored but taken by complement: with f0 the value of two zeros,
   sum f = sum over cells of n(i,j) (f(i,j) - f(i,0) - f(0,j) + f0) + sum over i of n(i) (f(i,0) - f0) + same for j + V f0.
   The first sum needs words that both groups use, the others only each group's histogram of counts.
4. The parts are added by pair and ranked.

A row for every ordered pair of sources of a language is the result itself, so its size is fixed by the question; a task never holds
more than one word, 64 terms times the sources of a language, and compares a bounded block of bitmaps at once.

NULL text, lang or source count as ''. Every row is a document, also where ids repeat or are NULL; the id and other columns are
not read. Groups without terms, and languages that keep no term, have pairs of value 0. Ties are ordered by the item's UTF-8
bytes. An empty table gives an empty result. Very long texts are counted piecewise between words.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.tables import store
from holdfast.session import ship_package

LEAST_DOCS, SCALE, PRIOR, TOP = 30, 1_000_000_000, 5, 50
WORD = 64
PART = 4096  # terms numbered by one window
LONG = 4 << 20  # bytes of text counted at once
FLUSH = 300_000  # different (group, term) a task holds before it hands them on
BLOCK = 1 << 21  # cells compared at once

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
_PLAIN = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _LETTERS or b >= 0x80 else 0x20 for b in range(256))


def _pieces(text: bytes):
    """Words of a text, in lists of bounded length; every other character has become a blank."""
    plain, start = text.translate(_PLAIN), 0
    while len(plain) - start > LONG:
        end = plain.find(b" ", start + LONG)
        if end < 0:
            break
        yield plain[start:end].split()
        start = end
    yield (plain[start:] if start else plain).split()


def _counted(batches):
    """(lang, source, term, n, docs) of what a task reads; a row without a term says that the group occurs."""
    found: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def handed():
        for (lang, source), (n, docs) in found.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64()),
            ], ["lang", "source", "term", "n", "docs"])
        found.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            n, docs = found[lang.as_py(), source.as_py()]
            own: set = set()
            for words in _pieces(text.as_py()):
                n.update(words)
                own.update(words)
            docs.update(own)
        if sum(len(n) for n, _ in found.values()) > FLUSH:
            yield from handed()
    yield from handed()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences and docs with it; term is NULL in one row of every group."""
    ship_package(docs.sparkSession)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    raw = docs.select(*text).withColumn("text", F.col("text").cast("binary"))
    counted = raw.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count, exact; 0 where no term is kept."""
    part = (n.cast("decimal(20,0)") + PRIOR) * F.lit(SCALE).cast("decimal(10,0)")
    whole = total.cast("decimal(20,0)") + terms.cast("decimal(18,0)") * PRIOR
    return F.when(terms > 0, F.lit(1).cast("bigint") + F.call_function("div", part, whole)).otherwise(F.lit(0).cast("bigint"))


class Audit:
    """Written intermediate tables: counts of kept terms, groups, and bitmaps."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        counts = store(term_counts(docs), "term-counts")
        term = Window.partitionBy("lang", "term")
        everywhere = counts.filter("term IS NOT NULL").withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term)})
        self.kept = store(everywhere.filter(F.col("lang_docs") >= least_docs).drop("docs", "lang_docs"), "kept-terms")
        self.terms = self.kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
        langs = self.terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        own = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.filter("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left")
        groups = groups.fillna(0, ["v", "lang_total", "total"])
        zero = share(F.lit(0), F.col("total"), F.col("v"))
        self.groups = store(groups.withColumn("p0", zero), "term-groups")

    def placed(self) -> DataFrame:
        """lang, term, its word (three numbers) and bit."""
        band = F.length(F.bin("lang_n"))
        sizes = store(self.terms.groupBy("lang", band.alias("band")).agg(F.ceil(F.count("*") / PART).alias("parts")), "band-sizes")
        dealt = self.terms.withColumn("band", band).join(sizes, ["lang", "band"])
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
        number = F.row_number().over(Window.partitionBy("lang", "band", "part").orderBy("term")) - 1
        return dealt.select("lang", "term", "band", "part", F.floor(number / WORD).alias("word"), (number % WORD).alias("bit"))

    def bitmaps(self) -> DataFrame:
        """lang, source, count level n with its p and the group's p0, word and bits."""
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
        placed = self.kept.join(self.placed(), ["lang", "term"])
        levels = placed.groupBy("lang", "source", "n", "band", "part", "word").agg(F.bit_or(bit).alias("bits"))
        joined = levels.join(self.groups, ["lang", "source"])
        return joined.withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).select("lang", "source", "n", "p", "p0", "band", "part", "word", "bits")

    def pairs(self) -> DataFrame:
        """lang, source, other source as item, and value."""
        maps = store(self.bitmaps(), "term-bitmaps")
        cells = maps.select("lang", "band", "part", "word", "source", "p", "p0", "bits").groupBy("lang", "band", "part", "word")
        joint = cells.applyInArrow(_joint, "lang string, source string, item string, value bigint")
        levels = maps.groupBy("lang", "source", "p").agg(F.sum(F.bit_count("bits")).alias("terms"))
        levels = levels.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("levels"))
        others = self.groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("others"))
        # One row per ordered pair, as the result has; the groups stay spread by source, only the short lists of a language come to them.
        pairs = self.groups.join(levels, ["lang", "source"], "left").join(others, "lang").select(
            "lang", "source", "p0", "v", "levels", F.explode("others").alias("other")
        ).filter(F.col("source") != F.col("other.source"))
        both_zero = F.abs(F.col("p0") - F.col("other.p0"))
        own = F.aggregate(
            F.coalesce("levels", F.array().cast("array<struct<p: bigint, terms: bigint>>")), F.lit(0).cast("bigint"),
            lambda s, x: s + x["terms"] * (F.abs(x["p"] - F.col("other.p0")) - both_zero),
        )
        half = pairs.select("lang", "source", F.col("other.source").alias("item"), own.alias("own"), (F.col("v") * both_zero).alias("zeros"))
        here = half.select("lang", "source", "item", (F.col("own") + F.col("zeros")).alias("value"))
        there = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("value"))
        back = joint.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        parts = here.unionByName(there).unionByName(joint).unionByName(back)
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def leading_terms(self) -> DataFrame:
        """lang, source, term as item, and value, of terms more frequent in the group than in its language."""
        joined = self.kept.filter("n > 0").join(self.groups, ["lang", "source"])
        more = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
        return joined.select("lang", "source", F.col("term").alias("item"), more.alias("value")).filter("value > 0")


def joint_values(source: np.ndarray, p: np.ndarray, p0: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bitmaps sorted by source, numbered from 0: a matrix with the first sum of the module's formula for each two sources."""
    starts = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
    out = np.zeros((len(starts), len(starts)), np.int64)
    ends = np.r_[starts[1:], len(source)]
    step = max(1, BLOCK // len(source))
    for k in range(0, len(source), step):
        row = slice(k, k + step)
        cells = np.bitwise_count(bits[row, None] & bits[None, :]).astype(np.int64)
        more = np.abs(p[row, None] - p) - np.abs(p[row, None] - p0) - np.abs(p0[row, None] - p) + np.abs(p0[row, None] - p0)
        by_other = np.add.reduceat(cells * more, starts, axis=1)
        np.add.at(out, np.searchsorted(ends, np.arange(k, min(k + step, len(source))), side="right"), by_other)
    return source[starts], out


def _joint(table: pa.Table) -> pa.Table:
    """Joint cells of one word for each two different sources, once."""
    table = table.sort_by("source")
    names = table.column("source").combine_chunks().dictionary_encode()
    read = lambda c: table.column(c).to_numpy()
    present, sums = joint_values(names.indices.to_numpy(), read("p"), read("p0"), read("bits").view(np.uint64))
    a, b = np.triu_indices(len(present), 1)
    words = names.dictionary
    return pa.table({
        "lang": pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()), "source": words.take(pa.array(present[a])).cast(pa.string()),
        "item": words.take(pa.array(present[b])).cast(pa.string()), "value": pa.array(sums[a, b], pa.int64()),
    })


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    audit = Audit(docs, least_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(order))
    terms = audit.leading_terms().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")
