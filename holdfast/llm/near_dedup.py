"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a fingerprint of the set and a MinHash signature.
   Documents with equal sets form a class; from here on only classes are compared.
2. Classes that agree in a band of the signature share a bucket. Each bucket links its members to its smallest one,
   so a bucket of n members gives n - 1 candidates. Bands and rows follow from `percent`: a pair at the threshold shares
   no band, and so is never a candidate, with a chance of at most MISS (6.6e-7 at 80, 7.7e-7 at 85), a closer one with less.
3. A candidate's signatures are compared in batches. After n positions with m matches, the similarity has a Beta
   posterior; where the chance of reaching the threshold is under MISS, the pair is dropped. Survivors are verified
   exactly on the full sets. MISS bounds each of the two steps, not their sum.
4. Links make components. In buckets that still hold several, the members outside the largest meet, TURNS times, one member
   of it that is drawn anew; most of a large group joins so. The rest is decided by the full sets of all members that still
   share a bucket with another component: shingles are put into one order, rarest first, and two sets are compared by 3 only if
   they share a shingle so early in both that the threshold can still be reached. This loses no pair, and members whose
   own shingles fill their prefix meet nobody, however large their bucket is.

Sets of equal hashes are taken as equal. Documents without words (NULL or empty texts too) have no set and are linked with
nothing; a NULL id gets component NULL and is kept. Rows with the same id count as one document: a link of any goes
for all. The smallest id stands for a component. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.components import components
from holdfast.llm.hashing import RangeHashes, mixed
from holdfast.llm.tables import intermediate, map_batches, store, text_slices

HASHES = 144  # more only where a low threshold asks for more bands
BATCH = 24
MISS = 1e-6
TURNS = 3
SPREAD = 16  # parts of one centre's verification
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache
def banding(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows: as many rows as HASHES allows with a chance of at most `miss` that a pair at the threshold shares no band."""
    if percent <= 0:
        raise ValueError("percent must be over 0: below, sets without a common shingle are similar too")
    if percent >= 100:
        return 1, HASHES  # only equal sets, which agree in all
    needed = lambda rows: ceil(log(miss) / log1p(-((percent / 100) ** rows)))
    rows = max((r for r in range(1, HASHES + 1) if needed(r) * r <= HASHES), default=1)
    return needed(rows), rows


def signature_length(percent: int) -> int:
    bands, rows = banding(percent)
    return max(HASHES, bands * rows)


@lru_cache
def _functions(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of the hash functions."""
    seeds = np.random.default_rng(977)
    factors = seeds.integers(0, 1 << 31, length, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors, seeds.integers(0, 1 << 32, length, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and where each text's begin (and the end)."""
    parts = [(t or "").encode().lower() for t in texts]  # bytes.lower() changes A-Z alone
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    lengths = np.array([len(p) + 1 for p in parts])
    ends_of_text = np.cumsum(lengths)
    gap = _SPACE[data]
    word = ~gap
    first = np.flatnonzero(word & np.concatenate([[True], gap[:-1]]))
    last = np.flatnonzero(word & np.concatenate([gap[1:], [True]])) + 1
    hashes = RangeHashes(data).of(first, last) ^ mixed((last - first).astype(np.uint64))
    owner = np.searchsorted(ends_of_text, first, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(counts) - counts
    # Shingles begin at every word but the last size - 1 of a text; a shorter text is one shingle.
    place = np.arange(len(first)) - starts[owner]
    n_words = counts[owner]
    begins = np.flatnonzero((place + size <= n_words) | ((place == 0) & (n_words < size)))
    total = np.zeros(len(begins), np.uint64)
    for k in range(size):
        inside = place[begins] + k < n_words[begins]
        at = np.minimum(begins + k, len(first) - 1)
        total = np.where(inside, mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[at]), total) if len(begins) else total
    owner = owner[begins]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[new], owner[new]
    return total, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray, length: int = HASHES) -> np.ndarray:
    """MinHash values of every set that is not empty: (sets, length) unsigned 32-bit numbers."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    narrow = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), length), np.uint32)
    factors, shifts = _functions(length)
    if len(starts):
        for k in range(length):
            out[:, k] = np.minimum.reduceat(narrow * factors[k] + shifts[k], starts)
    return out


def _hashed(size: int, length: int):
    def run(batch: pa.RecordBatch):
        for part in text_slices(batch, 1 << 19):
            hashes, bounds = shingle_sets(part.column("text").to_pylist(), size)
            counts = np.diff(bounds)
            made = iter(signatures(hashes, bounds, length))
            prints, signs = [], []
            for k, n in enumerate(counts.tolist()):
                prints.append(xxhash.xxh3_128_digest(hashes[bounds[k] : bounds[k + 1]].tobytes()) if n else None)
                signs.append(next(made).tobytes() if n else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())],
                ["doc_id", "n_shingles", "print", "signature"],
            )

    return run


def _banded(percent: int):
    (bands, rows), length = banding(percent), signature_length(percent)

    def run(batch: pa.RecordBatch):
        signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, length)
        signs = signs[:, : bands * rows].reshape(-1, bands, rows)
        keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), signs.shape[:2])
        for row in range(rows):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + signs[:, :, row].astype(np.uint64))
        nodes = np.repeat(batch.column("node").to_numpy(), bands)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes)], ["bucket", "node"])

    return run


@lru_cache
def fewest_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """By number of positions compared: fewest matches with a chance of at least `miss` that similarity reaches threshold."""
    grid = np.linspace(0, 1, 4001)[1:-1]
    fewest = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        density = np.exp(log - log.max(axis=1, keepdims=True))
        chance = density[:, grid >= threshold].sum(axis=1) / density.sum(axis=1)
        fewest[n] = int(np.argmax(chance >= miss))
    return fewest


def _pruned(percent: int):
    threshold, length = percent / 100, signature_length(percent)

    def run(batch: pa.RecordBatch):
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, length) for c in ("left", "right"))
        fewest, alive, matches = fewest_matches(threshold), np.arange(len(left)), np.zeros(len(left), np.int64)
        for start in range(0, HASHES, BATCH):
            matches = matches + (left[alive, start : start + BATCH] == right[alive, start : start + BATCH]).sum(axis=1)
            stay = matches >= fewest[min(start + BATCH, HASHES)]
            alive, matches = alive[stay], matches[stay]
        chosen = pa.array(alive)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(chosen), batch.column("b").take(chosen)], ["a", "b"])

    return run


def _verified(percent: int):
    """Rows sorted by centre; a centre's own set comes before those of its partners."""

    def run(batches):
        centre, own = None, []
        for batch in batches:
            found = []
            columns = (batch.column(c) for c in ("a", "b", "hashes"))
            for a, b, packed in zip(*columns):
                a, b, this = a.as_py(), b.as_py(), np.frombuffer(packed.as_buffer(), np.uint64)
                if b is None:
                    own = [*own, this] if centre == a else [this]
                    centre = a
                else:
                    for other in own if centre == a else ():
                        both = np.intersect1d(this, other, assume_unique=True).size
                        if 100 * both >= percent * (this.size + other.size - both):
                            found.append((a, b))
                            break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def _full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, hashes): the packed full sets of the nodes, stored, so that texts move once."""

    def run(batch: pa.RecordBatch):
        for part in text_slices(batch, 1 << 20):
            hashes, bounds = shingle_sets(part.column("text").to_pylist(), size)
            packed = [hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(packed, pa.binary())], ["node", "hashes"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(nodes, "node")
    return store(map_batches(texts, run, "node bigint, hashes binary").filter("octet_length(hashes) > 0"), "sets")


def _links(sets: DataFrame, signs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar, stored."""
    with_signs = pairs.join(signs.select(F.col("node").alias("a"), F.col("signature").alias("left")), "a").join(
        signs.select(F.col("node").alias("b"), F.col("signature").alias("right")), "b"
    )
    likely = store(map_batches(with_signs, _pruned(percent), "a bigint, b bigint").distinct(), "likely")
    salt = F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int").alias("part")
    centres = likely.select("a", salt).distinct().join(sets.withColumnRenamed("node", "a"), "a").select(
        "a", "part", F.lit(None).cast("bigint").alias("b"), "hashes"
    )
    partners = likely.select("a", salt, "b").join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "hashes")
    rows = centres.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return store(rows.mapInArrow(_verified(percent), "a bigint, b bigint"), "links")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components: bucket, node, component, and the bucket's largest component."""
    labelled = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    several = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("kinds"))
    return store(labelled.join(several.filter("kinds > 1").select("bucket", "largest"), "bucket"), "mixed")


def _limits(sets: DataFrame, here: DataFrame) -> DataFrame:
    """(node, size, shared) of the nodes in `here`: set sizes, and how many shingles any other of these nodes has too.

    A node with several texts gets NULL, as no limit holds for it.
    """

    def run(batch: pa.RecordBatch):
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            packed = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("hashes")]
            nodes = np.repeat(part.column("node").to_numpy(), [len(x) for x in packed])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(packed)), pa.array(nodes)], ["shingle", "node"])

    own = sets.join(here.select("node").distinct(), "node")
    once = map_batches(own, run, "shingle bigint, node bigint").groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    alone = once.groupBy("node").agg(F.count("*").alias("alone"))
    sizes = own.groupBy("node").agg(F.count("*").alias("texts"), F.max(F.expr("octet_length(hashes) div 8")).alias("size"))
    single = F.col("texts") == 1
    return store(sizes.join(alone, "node", "left").select(
        "node", F.when(single, F.col("size")).alias("size"), F.when(single, F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared")
    ), "limits")


def _possible(percent: int):
    """Two sets can't share more than what either shares with any; NULL limits exclude nothing."""
    most = F.least("shared", "other_shared")
    return F.coalesce(100 * most >= percent * (F.col("size") + F.col("other_size") - most), F.lit(True))


def _exploded(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set_id, size and shingle of the sets of some nodes; a node with several texts has several sets."""

    def run(batch: pa.RecordBatch):
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            packed = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("hashes")]
            sizes = np.array([len(x) for x in packed])
            repeated = [pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in ("node", "set_id")]
            yield pa.RecordBatch.from_arrays(
                [*repeated, pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(packed))], ["node", "set_id", "size", "shingle"]
            )

    own = sets.join(nodes, "node").select("node", F.xxhash64("hashes").alias("set_id"), "hashes")
    return map_batches(own, run, "node bigint, set_id bigint, size bigint, shingle bigint")


def _prefixes(sets: DataFrame, here: DataFrame, percent: int) -> DataFrame:
    """node, component, size, shingle and its place in the set's order, as far as a similar set must share one of them."""
    nodes = here.select("node", "component").distinct()
    rows = _exploded(sets, nodes.select("node"))
    held = rows.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1")
    shared = rows.join(store(held, "held"), "shingle")
    ordered = shared.groupBy("node", "set_id", "size").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("order"))
    alone = F.col("size") - F.size("order")  # shingles of no other set come first and are shared with nobody
    most = F.floor(F.col("size") * (100 - percent) / 100) + 1 - alone
    early = ordered.filter(most > 0).select("node", "size", alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), most.cast("int"))).alias("k", "entry"))
    return early.select("node", "size", F.col("entry.shingle").alias("shingle"), (F.col("alone") + F.col("k")).alias("place")).join(nodes, "node")


def _early_pairs(sets: DataFrame, here: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes in different components that share a shingle early enough to be similar."""
    left = store(_prefixes(sets, here, percent), "prefixes")
    right = left.select("shingle", *(F.col(c).alias(f"other_{c}") for c in ("node", "component", "size", "place")))
    most = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))  # shingles from here on
    reach = (100 + percent) * most >= percent * (F.col("size") + F.col("other_size"))
    apart = (F.col("node") < F.col("other_node")) & (F.col("component") != F.col("other_component"))
    met = left.alias("x").join(right.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & apart & reach)
    return met.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()


def _ordered(x: str, y: str) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _paired(few: DataFrame, many: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket in different components that can be similar at all."""
    other = many.select(
        F.col("bucket").alias("other_bucket"), F.col("node").alias("other"), F.col("component").alias("other_component"),
        F.col("size").alias("other_size"), F.col("shared").alias("other_shared"),
    )
    condition = (F.col("bucket") == F.col("other_bucket")) & (F.col("component") != F.col("other_component")) & _possible(percent)
    return few.join(other, condition).select(*_ordered("node", "other")).distinct()


def _drawn(here: DataFrame, turn: int) -> DataFrame:
    """One member of each bucket's largest component, another one every turn."""
    large = here.filter("component = largest")
    best = F.min_by(F.struct(*large.columns), F.xxhash64("node", "bucket", F.lit(turn)))
    return large.groupBy("bucket").agg(best.alias("best")).select("best.*")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; stored, what led to it is deleted."""
    with intermediate(docs.sparkSession):
        return store(_near_duplicates(docs, size, percent), "near-duplicates", keep=True)


def _near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    hashed = store(
        map_batches(
            docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _hashed(size, signature_length(percent)),
            "doc_id bigint, n_shingles bigint, print binary, signature binary",
        ), "hashed",
    )
    usable = hashed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("print").agg(F.min("doc_id").alias("node"))
    signs = store(
        usable.join(classes.withColumnRenamed("node", "doc_id"), ["print", "doc_id"]).select(F.col("doc_id").alias("node"), "signature").distinct(),
        "signatures",
    )
    rows = map_batches(signs, _banded(percent), "bucket bigint, node bigint")
    shared = rows.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a < most")
    buckets = store(rows.join(shared.select("bucket", "a"), "bucket"), "buckets")
    stars = store(buckets.filter("a != node").select("a", F.col("node").alias("b")).distinct(), "stars")
    sets = _full_sets(docs, buckets.select("node").distinct(), size)
    links = _links(sets, signs, stars, percent)
    labels = components(links)
    tested, members, limits = stars, buckets.select("bucket", "node"), None
    for turn in range(TURNS + 1):
        here = _mixed(members, labels)
        if here.isEmpty():
            break
        limits = limits or _limits(sets, here)  # later buckets are among the first, so these limits go on holding
        here = here.join(limits, "node")
        if turn < TURNS:
            found = _paired(here.filter("component != largest"), _drawn(here, turn), percent)
        else:
            found = _early_pairs(sets, here, percent)
        fresh = store(found.join(tested, ["a", "b"], "left_anti"), "fresh")
        if not fresh.isEmpty():
            links = links.unionByName(_links(sets, signs, fresh, percent))
            tested = tested.unionByName(fresh)
            labels = components(links)
    classed = hashed.select("doc_id", "n_shingles", "print").join(classes, "print", "left")
    # Rows with one id but different texts belong together.
    own = classed.filter("doc_id IS NOT NULL AND node != doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    twice = hashed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("print").alias("n")).filter("n > 1").select(F.col("doc_id").alias("a"))
    if not twice.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(own.join(twice, "a")))
    joined = classed.join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
