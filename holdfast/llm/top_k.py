"""Exact top-k inner products over vectors in buckets of similar length.

Components become floor(256 * x). Vectors are grouped by dimension and by the logarithm of their length, and groups that
are large are cut into chunks by a hash, so no group has to fit into one task. Queries are packed into blocks. Of every
(chunk, block) first only the figures meet: if no query of the block can reach its threshold even with the chunk's greatest length, nothing is
moved. For the others the block, the smaller of the two, is sent to its chunks, and the work is spread over the chunks.

A query's threshold is its k-th best product with the SEEDS longest vectors of its dimension. In a chunk it becomes a local
cosine threshold: threshold / (query's length * the chunk's greatest length). Over 1, the chunk is skipped. If it is high,
candidates are those whose coordinate in the query's strongest direction lies in the only range that can reach it
(coordinate pruning); if low, those long enough (length pruning). Their products are then computed exactly,
and the best k of all chunks remain. Ties in score go to the smaller id.

NULL vectors, vectors with NULL or non-finite components and rows with NULL ids take no part. Vectors of different
dimension are not compared. Repeated rows are candidates each; a query row leaves out all rows with its own id.
An empty table gives an empty result; other columns are not read. Scores are 64-bit integers; vectors so large that a product could
leave them are refused with a ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from holdfast.llm.tables import map_batches, store
from holdfast.session import ship_package

CHUNK, BLOCK, SEEDS = 2048, 1024, 1024
SHRINK = 0.9  # shortest against longest vector of a length bucket
HIGH_COSINE = 0.3


def whole_vectors(table: DataFrame) -> DataFrame:
    """vec_id, dim, bucket and the integer components of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = table.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("bigint")).alias("v"),
    )
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    rows = rows.withColumn("dim", F.size("v")).withColumn("length", length)
    return rows.withColumn("bucket", F.when(F.col("length") > 0, F.floor(F.log("length") / float(-np.log(SHRINK)))).otherwise(-(1 << 40)))


def _matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(-1, dim) if dim else np.zeros((len(blob), 0), np.int64)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integers: by floating point where it can't round."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1] < 2**52:
        return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    return queries @ vectors.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def search(query: np.ndarray, threshold: float, vectors: np.ndarray, lengths: np.ndarray, unit: np.ndarray, orders: dict) -> np.ndarray:
    """Places of the vectors of a chunk, sorted by falling length, that may reach the threshold."""
    size = float(np.sqrt((query.astype(float) ** 2).sum()))
    if threshold <= 0 or not size:
        return np.arange(len(vectors))
    cosine = threshold / (size * lengths[0]) if lengths[0] else 2.0
    if cosine > 1 + 1e-9:
        return np.zeros(0, np.int64)
    long_enough = np.searchsorted(-lengths, -threshold / size * (1 - 1e-9), side="right")
    if cosine < HIGH_COSINE:
        return np.arange(long_enough)
    axis = int(np.abs(query).argmax())
    if axis not in orders:
        order = np.argsort(unit[:, axis], kind="stable")
        orders[axis] = order, unit[order, axis]
    order, values = orders[axis]
    own, reach = np.arccos(np.clip(query[axis] / size, -1, 1)), np.arccos(min(1.0, cosine))
    low, high = np.cos(min(np.pi, own + reach)), np.cos(max(0.0, own - reach))
    found = order[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, side="right")]
    return found[found < long_enough]


def _packed(table: pa.Table) -> pa.Table:
    """One row for a chunk or block: ids, components, and thresholds where there are any."""
    vectors = table.column("v").combine_chunks()
    dim = table.column("dim")[0].as_py()
    values = vectors.flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((table.num_rows, 0), np.int64)
    order = np.argsort(-table.column("length").to_numpy(), kind="stable")
    blob = values[order].astype(np.int64).tobytes() if dim else bytes(table.num_rows)
    lengths, thresholds = table.column("length").to_numpy(), table.column("threshold").to_numpy().astype(float)
    if dim and float(lengths.max()) ** 2 >= 2.0**62:
        raise ValueError("vectors are too long for exact products in 64 bits")
    reach = np.divide(thresholds, lengths, out=np.full(len(lengths), -np.inf), where=lengths > 0)
    return pa.table({
        "longest": pa.array([float(lengths.max())]), "reach": pa.array([float(reach.min())]),
        "dim": pa.array([dim], pa.int32()), "part": pa.array([table.column("part")[0].as_py()], pa.int64()),
        "ids": pa.array([table.column("vec_id").to_numpy()[order].tobytes()], pa.binary()), "vectors": pa.array([blob], pa.binary()),
        "lengths": pa.array([table.column("length").to_numpy()[order].tobytes()], pa.binary()),
        "thresholds": pa.array([table.column("threshold").to_numpy()[order].astype(float).tobytes()], pa.binary()),
    })


PACKED = "longest double, reach double, dim int, part bigint, ids binary, vectors binary, lengths binary, thresholds binary"


def _met(k: int):
    """Best k of every query of a block in one chunk."""

    def run(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            dim = row["dim"]
            queries, vectors = _matrix(row["q_vectors"], dim), _matrix(row["vectors"], dim)
            q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
            lengths, thresholds = np.frombuffer(row["lengths"], float), np.frombuffer(row["q_thresholds"], float)
            unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
            orders: dict = {}
            found = []
            for q, query_id in enumerate(q_ids.tolist()):
                some = search(queries[q], thresholds[q], vectors, lengths, unit, orders)
                some = some[ids[some] != query_id]
                scores = _products(queries[q : q + 1], vectors[some])[0]
                reach = scores >= thresholds[q]
                some, scores = some[reach], scores[reach]
                for j in _best(scores, ids[some], k).tolist():
                    found.append((query_id, int(ids[some[j]]), int(scores[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"])

    return run


def _with_thresholds(seeds: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    def run(batch: pa.RecordBatch):
        thresholds = np.full(batch.num_rows, -np.inf)
        for row, (vec_id, dim, vector) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "v")))):
            ids, vectors = seeds[dim]
            scores = _products(np.array([vector], np.int64).reshape(1, dim), vectors)[0][ids != vec_id]
            if len(scores) >= k:
                thresholds[row] = np.partition(scores, len(scores) - k)[len(scores) - k]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("vec_id", "dim", "v", "length")), pa.array(thresholds)], ["vec_id", "dim", "v", "length", "threshold"]
        )

    return run


def top_k(table: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score; is_query is a condition on the table's rows."""
    ship_package(table.sparkSession)
    rows, queries = whole_vectors(table), whole_vectors(table.filter(is_query))
    longest = Window.partitionBy("dim").orderBy(F.desc("length"), "vec_id")
    few = rows.withColumn("r", F.row_number().over(longest)).filter(F.col("r") <= SEEDS).select("dim", "vec_id", "v").collect()
    seeds = {}
    for dim in {r["dim"] for r in few}:  # at most SEEDS vectors of each dimension
        own = [r for r in few if r["dim"] == dim]
        seeds[dim] = np.array([r["vec_id"] for r in own]), np.array([r["v"] for r in own], np.int64).reshape(len(own), dim)
    counts = {(r["dim"], r["bucket"]): r["count"] for r in rows.groupBy("dim", "bucket").count().collect()}  # a few buckets per dimension
    asked = {r["dim"]: r["count"] for r in queries.groupBy("dim").count().collect()}
    # Numbers of parts as constants in the plan; a bucket's parts hold CHUNK vectors on average.
    parts = F.lit(1)
    for (dim, bucket), n in counts.items():
        if n > CHUNK:
            parts = F.when((F.col("dim") == dim) & (F.col("bucket") == bucket), -(-n // CHUNK)).otherwise(parts)
    blocks = F.lit(1)
    for dim, n in asked.items():
        blocks = F.when(F.col("dim") == dim, -(-n // BLOCK)).otherwise(blocks)
    none = F.lit(0.0).alias("threshold")
    chunks = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts)).select("vec_id", "dim", "bucket", "part", "v", "length", none)
    chunks = store(chunks.groupBy("dim", "bucket", "part").applyInArrow(_packed, PACKED).withColumn("chunk", F.xxhash64("dim", "ids", "vectors")), "chunks")
    ready = map_batches(
        queries.select("vec_id", "dim", "v", "length"), _with_thresholds(seeds, k), "vec_id bigint, dim int, v array<bigint>, length double, threshold double"
    ).withColumn("part", F.pmod(F.xxhash64("vec_id"), blocks))
    packed = store(ready.groupBy("dim", "part").applyInArrow(_packed, PACKED).select(
        "dim", F.col("part").alias("block"), "reach", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("thresholds").alias("q_thresholds")
    ), "blocks")
    # A threshold is at most query length * chunk length * cosine 1, so shorter chunks can't reach it.
    figures = chunks.select("dim", "chunk", "longest", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("bigint"))).alias("block"))
    possible = figures.join(packed.select("dim", "block", "reach"), ["dim", "block"]).filter(F.col("longest") * (1 + 1e-9) >= F.col("reach"))
    sent = possible.select("dim", "block", "chunk").join(packed.drop("reach"), ["dim", "block"])
    both = sent.join(chunks.select("dim", "chunk", "ids", "vectors", "lengths"), ["dim", "chunk"])
    met = map_batches(both, _met(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
