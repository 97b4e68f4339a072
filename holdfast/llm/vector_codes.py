"""Product codes of integer vectors, trained by rounds of exact nearest-entry assignment over value dictionaries.

Components become floor(256 * x); a vector is cut into equal consecutive parts and each part position has its codebook, which
starts as that part of the vectors with the smallest ids. A round assigns every part to the nearest entry (squared distance,
ties to the lower index) and replaces each used entry by the componentwise floor of its parts' mean.

Tasks first write the vectors once as chunks: for every dimension the sorted distinct integers of the chunk (its dictionary) and
small codes into it. A pass then tabulates, per dimension, the squared differences of each distinct integer to all entries;
distances of parts are gathers from these tables by code, and adds. Sums for new entries come from counts of
(entry, code) pairs times the dictionary. Each task adds up its own chunks, Spark adds the tasks' sums by (component, entry), and only
the codebooks, entries times dimension whatever the number of rows, pass through the driver.

Vectors that are NULL or hold a NULL or non-finite component take no part. Rows with a NULL id are coded like others and come
last in the order of ids; among rows of one id the smaller vector comes first. Fewer rows than entries give smaller codebooks.
Vectors of different dimension have codebooks of their own; a dimension that the parts don't divide is filled up with zeros at
the end. An empty table gives an empty result; other columns are not read. Distances are exact in 64 bits; components so
large that a distance could leave them (over 10^8 for usual dimensions) are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from holdfast.llm.tables import store
from holdfast.session import ship_package

PARTS, ENTRIES, ROUNDS = 16, 64, 2
CHUNK = 1 << 20  # components in a chunk, so tables and distances of a task stay at some 10 MB

CHUNKS = "dim int, rows array<struct<vec_id: bigint, label: {label}>>, sizes binary, dictionaries binary, codes binary"


def usable(table: DataFrame, label: str = "label") -> DataFrame:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return table.filter(x.isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("embedding"), F.col(f"`{label}`").alias("label")
    )


def integers(vectors: np.ndarray, parts: int) -> np.ndarray:
    """floor(256 * x), filled up with zeros so that the parts are equal."""
    whole = np.floor(256.0 * vectors)
    width = -(-vectors.shape[1] // parts) * parts
    # A difference has at most twice the size, its square is added over one part and then over all of them.
    if whole.size and 4.0 * float(np.abs(whole).max()) ** 2 * width >= 2.0**62:
        raise ValueError("components are too large for exact distances in 64 bits")
    out = np.zeros((len(vectors), width), np.int64)
    out[:, : vectors.shape[1]] = whole
    return out


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places of rows, their vectors) in pieces of about CHUNK components."""
    vectors = batch.column("embedding")
    sizes = np.diff(vectors.offsets.to_numpy())
    values, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == dim)
        step = max(1, CHUNK // max(1, dim))
        for k in range(0, len(places), step):
            some = places[k : k + step]
            yield dim, some, values[starts[some][:, None] + np.arange(dim)]


def _chunks(parts: int):
    def run(batches):
        for batch in batches:
            for dim, places, vectors in _by_dimension(batch):
                columns = integers(vectors, parts).T
                dictionaries, codes = [], []
                for column in columns:
                    values, code = np.unique(column, return_inverse=True)
                    dictionaries.append(values)
                    codes.append(code.astype("<u4"))
                few = batch.take(pa.array(places))
                rows = pa.StructArray.from_arrays([few.column("vec_id"), few.column("label")], ["vec_id", "label"])
                one = lambda x: pa.array([x], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), rows),
                    one(np.array([len(v) for v in dictionaries], "<i8").tobytes()),
                    one(np.concatenate(dictionaries or [np.zeros(0)]).astype("<i8").tobytes()),
                    one(np.concatenate(codes or [np.zeros(0)]).astype("<u4").tobytes()),
                ], ["dim", "rows", "sizes", "dictionaries", "codes"])

    return run


class Chunk:
    """Dictionaries and codes of a chunk, by dimension."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        read = lambda c, t: np.frombuffer(batch.column(c)[row].as_py(), t)
        self.dim, self.rows = batch.column("dim")[row].as_py(), batch.column("rows")[row].values
        ends = np.cumsum(read("sizes", "<i8"))
        self.dictionaries = np.split(read("dictionaries", "<i8"), ends[:-1]) if len(ends) else []
        self.codes = read("codes", "<u4").reshape(len(ends), len(self.rows))

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, for every row and part."""
        entries, parts, width = books.shape
        found = np.zeros((len(self.rows), parts), np.int64)
        errors = np.zeros((len(self.rows), parts), np.int64)
        for part in range(parts):
            distances = np.zeros((len(self.rows), entries), np.int64)
            for j in range(width):
                at = part * width + j
                table = (self.dictionaries[at][:, None] - books[None, :, part, j]) ** 2
                distances += table[self.codes[at]]
            found[:, part] = distances.argmin(axis=1)
            errors[:, part] = distances.min(axis=1)
        return found, errors

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, parts) rows assigned and (entries, parts, width) sums of their components."""
        entries, parts, width = books.shape
        found, _ = self.nearest(books)
        counts, sums = np.zeros((entries, parts), np.int64), np.zeros(books.shape, np.int64)
        for part in range(parts):
            counts[:, part] = np.bincount(found[:, part], minlength=entries)
            for j in range(width):
                at = part * width + j
                values = self.dictionaries[at]
                pairs = np.bincount(found[:, part] * len(values) + self.codes[at], minlength=entries * len(values))
                sums[:, part, j] = pairs.reshape(entries, len(values)) @ values
        return counts, sums


def _assigned(books: dict[int, np.ndarray]):
    """What a task's chunks add to each entry: one row per component and entry in use."""

    def run(batches):
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk(batch, row)
                counts, sums = chunk.sums(books[chunk.dim])
                if chunk.dim in totals:
                    totals[chunk.dim][0] += counts
                    totals[chunk.dim][1] += sums
                else:
                    totals[chunk.dim] = [counts, sums]
        for dim, (counts, sums) in totals.items():
            entry, part, place = (x.ravel() for x in np.indices(sums.shape))
            columns = [np.full(sums.size, dim), part, entry, place, counts[entry, part], sums.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "part", "entry", "place", "n", "total"])

    return run


def trained(chunks: DataFrame, books: dict[int, np.ndarray], rounds: int) -> dict[int, np.ndarray]:
    for _ in range(rounds):
        parts = chunks.mapInArrow(_assigned(books), "dim bigint, part bigint, entry bigint, place bigint, n bigint, total bigint")
        sums = parts.groupBy("dim", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0")
        books = {dim: book.copy() for dim, book in books.items()}
        for r in sums.collect():  # entries times dimension
            books[r["dim"]][r["entry"], r["part"], r["place"]] = r["total"] // r["n"]  # floors, also below zero
    return books


def first_books(rows: DataFrame, parts: int, entries: int) -> dict[int, np.ndarray]:
    """By dimension, (entries, parts, width): the vectors with the smallest ids."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    ranked = rows.withColumn("dim", F.size("embedding")).withColumn("r", F.row_number().over(order))
    few = sorted(ranked.filter(F.col("r") <= entries).select("dim", "r", "embedding").collect())
    books = {}
    for dim in {r["dim"] for r in few}:
        own = np.array([r["embedding"] for r in few if r["dim"] == dim], float).reshape(sum(r["dim"] == dim for r in few), dim)
        books[dim] = integers(own, parts).reshape(len(own), parts, -1)
    return books


def books_text(book: np.ndarray) -> str:
    """All components by part, entry and position within the part."""
    return ",".join(map(str, book.transpose(1, 0, 2).ravel().tolist()))


def _coded(books: dict[int, np.ndarray]):
    checksums = {dim: hashlib.sha256(books_text(book).encode()).hexdigest() for dim, book in books.items()}

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk(batch, row)
                found, errors = chunk.nearest(books[chunk.dim])
                digits, step = found.astype(np.uint8).tobytes().hex(), 2 * found.shape[1]
                yield pa.RecordBatch.from_arrays([
                    chunk.rows.field("vec_id"), chunk.rows.field("label"),
                    pa.array([digits[k : k + step] for k in range(0, len(digits), step)], pa.string()),
                    pa.array(errors.sum(axis=1)), pa.array([checksums[chunk.dim]] * len(found), pa.string()),
                ], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return run


def compress(table: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(vec_id, label, code, error, codebooks_sha256) of every usable row, and the codebooks by dimension."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hexadecimal digits: 1 to 256 entries")
    ship_package(table.sparkSession)
    rows = usable(table, label)
    kind = rows.schema["label"].dataType.simpleString()
    chunks = store(rows.mapInArrow(_chunks(parts), CHUNKS.format(label=kind)), "vector-chunks")
    books = trained(chunks, first_books(rows, parts, entries), rounds)
    coded = chunks.mapInArrow(_coded(books), f"vec_id bigint, label {kind}, code string, error bigint, codebooks_sha256 string")
    return store(coded, "vector-codes"), books


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the integer vector that a code stands for."""
    parts = [F.array(*(F.array(*map(F.lit, entry.tolist())) for entry in books[:, part])) for part in range(books.shape[1])]
    index = [F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int") for k in range(len(parts))]
    return codes.select("vec_id", F.concat(*(F.get(p, i) for p, i in zip(parts, index))).alias("vector"))


def digest(table: DataFrame) -> DataFrame:
    """Codes with their errors, and each row's label total (NULL labels are one group)."""
    coded, _ = compress(table)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own_label")
    totals = store(totals, "label-errors")  # so that a label with very many rows can be split in the join
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("own_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
