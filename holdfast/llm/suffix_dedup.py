"""Exact removal of repeated byte passages: depth-limited radix sort of sampled suffixes.

Two equal windows of DEPTH bytes hold the same smallest GRAM-byte string, so it is enough to sort the suffixes that
begin at those anchors, about one position in sixteen. Their digits are taken from the most significant on:

1. First digit: the anchor's gram. Suffixes are dealt out by its leading bits and split by the rest; groups
   within one document are done.
2. Second digit: the whole stretch over which an anchor stays the smallest (its windows joined). A group of equal
   stretches repeats window by window, so all but its smallest document lose all of these windows.
3. Last digit: where stretches of one gram differ, their windows are split one by one, down to DEPTH bytes and
   no further; equal groups are exactly the repeated windows.

Each task first keeps the smallest document alone of every group it holds itself, so a passage in very many
documents reaches a bucket once per task. Digits are compared by hashes within groups: stretches by more than 90
bits, single windows by 56 bits and those of their bucket, about 72 at 64 GB of text. Bytes are not compared again: with n windows in
doubt the expected number of false matches is n^2 / 2^73, below one up to some 10^11 such windows.

A byte goes if a window of DEPTH bytes that covers it also starts in a document with a smaller id. Windows never cross
documents and are judged on the input. NULL texts count as empty; texts shorter than DEPTH stay whole, as do
rows with a NULL id, which no other row is compared with. Rows with equal ids never match each other. An empty table
gives an empty result. Very long texts are worked on in overlapping blocks. Other columns are carried along by
`cleaned` and not read by `digest`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.hashing import RangeHashes, mixed
from holdfast.llm.tables import intermediate, release_memory, store, text_slices
from holdfast.session import ship_package

DEPTH, GRAM = 50, 22
BLOCK = 1 << 18  # bytes hashed at once: their arrays stay in a core's cache
CHUNK = 300_000  # anchors that a task gathers before it hands them out
BUCKET_BYTES = 1 << 20
# Columns of a packed table, with the bytes of each number that are kept (little-endian order).
OPEN = {"gram": (8, range(1, 6)), "whole": (8, range(1, 8)), "doc": (8, range(8)), "part": (8, range(8)), "low": (4, range(4)), "many": (4, range(4))}
WINDOWS = OPEN | {"whole": (8, range(1, 3))}  # one window each: with the gram's and the bucket's bits, 56 and more
DONE = {k: OPEN[k] for k in ("doc", "part", "low", "many")}
TYPES = {8: np.uint64, 4: np.uint32}


def _pack(columns: dict[str, np.ndarray], layout: dict) -> bytes:
    """Byte planes, so that the many zero bytes lie together; documents as differences."""
    n = len(columns["doc"])
    planes = [np.uint64(n).tobytes()]
    for name, (width, kept) in layout.items():
        values = columns[name].astype(TYPES[width])
        if name == "doc":
            values = np.diff(values, prepend=np.uint64(0))
        planes.append(np.ascontiguousarray(values).view(np.uint8).reshape(n, width).T[list(kept)].tobytes())
    return b"".join(planes)


def _unpack(blob: bytes, layout: dict) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.uint64, 1)[0]), 8, {}
    for name, (width, kept) in layout.items():
        full = np.zeros((width, n), np.uint8)
        full[list(kept)] = np.frombuffer(blob, np.uint8, len(kept) * n, at).reshape(len(kept), n)
        at += len(kept) * n
        values = np.ascontiguousarray(full.T).reshape(-1).view(TYPES[width])
        out[name] = np.cumsum(values, dtype=np.uint64).view(np.int64) if name == "doc" else values
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Byte arrays of about BLOCK bytes with their pieces (row, place in the text, place in the array)."""
    parts, pieces, size = [], [], 0
    for row, text in enumerate(batch.column("text").to_pylist()):
        data = np.frombuffer((text or "").encode(), np.uint8)
        for start in range(0, max(0, len(data) - DEPTH + 1), BLOCK):
            piece = data[start : start + BLOCK + DEPTH - 1]
            pieces.append((row, start, size))
            parts.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield np.concatenate(parts), pieces
                parts, pieces, size = [], [], 0
    if parts:
        yield np.concatenate(parts), pieces


def stretches(data: np.ndarray, pieces: list[tuple[int, int, int]]) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: gram and whole stretch as hashes, row, first window and number of windows."""
    hashes = RangeHashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = hashes.of(at, at + GRAM)
    bits = np.uint64(max(1, len(data)).bit_length())
    key = gram >> bits << bits | at.astype(np.uint64)  # the leftmost of equal grams
    width, size = DEPTH - GRAM + 1, 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    n = len(data) - DEPTH + 1
    anchor = (np.minimum(key[:n], key[width - size : width - size + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begins = np.array([p[2] for p in pieces])
    ends = np.append(begins[1:], len(data))
    owner = np.repeat(np.arange(len(pieces)), ends - begins)[:n]
    whole = np.flatnonzero(np.arange(n) + DEPTH <= ends[owner])
    anchor = anchor[whole]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    many = np.diff(np.append(first, len(whole)))
    low, anchor = whole[first], anchor[first]
    owner = owner[low]
    rows, places = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    return {
        "gram": gram[anchor], "whole": mixed(hashes.of(low, low + many - 1 + DEPTH) + (anchor - low).astype(np.uint64)),
        "row": rows[owner], "low": (low - begins[owner] + places[owner]), "many": many,
    }


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the group of every row of sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def _least(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, np.flatnonzero(np.diff(groups, prepend=-1)))[groups] if len(groups) else values


def _handed_out(found: dict[str, np.ndarray], buckets: int, layout: dict) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, open, done): of each group that this task holds, only its smallest document stays open."""
    names = ("gram", "whole")
    order = np.lexsort([found["doc"], *(found[k] for k in reversed(names))])
    found = {k: v[order] for k, v in found.items()}
    least = _least(_groups(*(found[k] for k in names)), found["doc"])
    bucket = ((found["gram"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((found["low"], found["part"], found["doc"], bucket))
    found, bucket, left = {k: v[order] for k, v in found.items()}, bucket[order], (found["doc"] == least)[order]
    numbers, starts = np.unique(bucket, return_index=True)
    rows = []
    for k, start, end in zip(numbers.tolist(), starts, np.append(starts[1:], len(bucket))):
        part = slice(start, end)
        mine = {c: v[part] for c, v in found.items()}
        stay = left[part]
        rows.append((k, _pack({c: v[stay] for c, v in mine.items()}, layout), _pack({c: v[~stay] for c, v in mine.items()}, DONE)))
    if rows:
        types = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["bucket", "open", "done"])


def _gathered(buckets: int, layout: dict, of_batch):
    """mapInArrow function that collects what of_batch finds and hands it out in chunks."""

    def run(batches):
        release_memory()
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in text_slices(batch, BLOCK):
                for found in of_batch(part):
                    held.append(found)
                    size += len(found["doc"])
                    if size >= CHUNK:
                        yield from _handed_out({k: np.concatenate([h[k] for h in held]) for k in held[0]}, buckets, layout)
                        held, size = [], 0
        if size:
            yield from _handed_out({k: np.concatenate([h[k] for h in held]) for k in held[0]}, buckets, layout)

    return run


def _ids(batch: pa.RecordBatch, rows: np.ndarray) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("doc", "part")}


def _anchors(batch: pa.RecordBatch):
    for data, pieces in _blocks(batch):
        found = stretches(data, pieces)
        yield found | _ids(batch, found.pop("row"))


def _asked_windows(batch: pa.RecordBatch):
    """Every window of the stretches that are asked about."""
    asked = batch.column("asked").to_pylist()
    for row, text in enumerate(batch.column("text").to_pylist()):
        packed = np.array(asked[row], np.int64)
        low, many = packed >> 20, packed & 0xFFFFF
        data = np.frombuffer(text.encode(), np.uint8)
        block = low // BLOCK
        for k in np.unique(block).tolist():
            base, here = k * BLOCK, block == k
            at = np.repeat(low[here], many[here]) + np.arange(many[here].sum()) - np.repeat(np.cumsum(many[here]) - many[here], many[here])
            stop = int(at.max()) + DEPTH
            window = RangeHashes(data[base:stop]).of(at - base, at - base + DEPTH)
            yield {"gram": window, "whole": mixed(window ^ np.uint64(0x5DEECE66D)), "low": at, "many": np.ones(len(at), np.int64)} | _ids(
                batch, np.full(len(at), row)
            )


def _split_bucket(layout: dict, last: bool):
    """All rows of a bucket: (doc, part, low, many, asked)."""

    def run(table: pa.Table) -> pa.Table:
        names = ("gram", "whole")
        entries = [_unpack(b, layout) for b in table.column("open").to_pylist()]
        done = [_unpack(b, DONE) for b in table.column("done").to_pylist()]
        found = {k: np.concatenate([e[k] for e in entries]) for k in OPEN}
        order = np.lexsort([found["doc"], *(found[k] for k in reversed(names))])
        found = {k: v[order] for k, v in found.items()}
        inner = _groups(*(found[k] for k in names))
        resolved = found["doc"] > _least(inner, found["doc"])
        asked = np.zeros(len(resolved), bool)
        if not last:
            outer = _groups(found["gram"])
            several = np.flatnonzero(np.diff(outer, prepend=-1))
            kinds = np.append(inner[several[1:] - 1], inner[-1])[outer] != inner[several][outer] if len(outer) else asked
            docs = np.maximum.reduceat(found["doc"], several)[outer] != np.minimum.reduceat(found["doc"], several)[outer] if len(outer) else asked
            asked = kinds & docs & ~resolved
        stay = resolved | asked
        out = {k: np.concatenate([found[k][stay], *(d[k] for d in done)]) for k in DONE}
        flags = np.concatenate([asked[stay], np.zeros(sum(len(d["doc"]) for d in done), bool)])
        return pa.table({
            "doc": pa.array(out["doc"], pa.int64()), "part": pa.array(out["part"].astype(np.uint64).view(np.int64)),
            "place": pa.array(out["low"].astype(np.int64) << 20 | out["many"].astype(np.int64)), "asked": pa.array(flags),
        })

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """doc, part, text and the other columns in `row`: part tells texts of one id apart.

    Rows of one id with equal texts may share a part, as they lose the same bytes. Rows with a NULL id take no part; theirs
    spreads them.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*others).alias("row"))
    unique = rows.filter("doc IS NOT NULL").groupBy("doc").count().filter("count > 1").isEmpty()
    of_text = F.xxhash64("text")
    return rows.withColumn("part", F.when(F.col("doc").isNull(), of_text).otherwise(F.lit(0).cast("bigint")) if unique else of_text)


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their part, dealt by doc and part, and (doc, part, places): packed stretches whose windows all repeat."""
    ship_package(docs.sparkSession)
    rows = _numbered(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(max(64, total // BUCKET_BYTES), (1 << 31) - 1))
    packed, schema = "bucket int, open binary, done binary", "doc bigint, part bigint, place bigint, asked boolean"
    usable = rows.select("doc", "part", "text").filter(F.col("doc").isNotNull() & (F.octet_length("text") >= DEPTH))
    first = usable.mapInArrow(_gathered(buckets, OPEN, _anchors), packed)
    with intermediate(docs.sparkSession):
        found = store(first.groupBy("bucket").applyInArrow(_split_bucket(OPEN, last=False), schema), "stretches")
        dealt = rows.repartition("doc", "part")
        asked = found.filter("asked").groupBy("doc", "part").agg(F.collect_set("place").alias("asked"))
        windows = dealt.join(asked, ["doc", "part"]).select("doc", "part", "text", "asked").mapInArrow(
            _gathered(buckets, WINDOWS, _asked_windows), packed
        )
        last = windows.groupBy("bucket").applyInArrow(_split_bucket(WINDOWS, last=True), schema)
        every = found.filter("NOT asked").select("doc", "part", "place").unionByName(last.select("doc", "part", "place"))
        places = store(every.groupBy("doc", "part").agg(F.collect_set("place").alias("places")), "places", keep=True)
    return dealt, places


def _removed(size: int, places: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of a text as starts and ends."""
    packed = np.sort(np.array(places or [], np.int64))
    low, end = packed >> 20, (packed >> 20) + (packed & 0xFFFFF) - 1 + DEPTH
    if not len(low):
        return low, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    return low[new], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])


def _kept(text: str | None, places: list[int] | None) -> tuple[bytes, int, int, int]:
    data = (text or "").encode()
    starts, ends = _removed(len(data), places)
    edges = [0, *np.column_stack([starts, ends]).reshape(-1).tolist(), len(data)]
    kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])])
    return kept, len(data), int((ends - starts).sum()), len(starts)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, BLOCK) if batch.num_rows else ():
                rows = [_kept(t, p) for t, p in zip(part.column("text").to_pylist(), part.column("places").to_pylist())]
                kept, sizes, removed, spans = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc"), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    dealt, places = repeated(docs.select("doc_id", "text"))
    joined = dealt.join(places, ["doc", "part"], "left").select("doc", "text", "places")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of docs with the remaining texts; bytes of characters that are cut in two are dropped."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, BLOCK) if batch.num_rows else ():
                texts = [_kept(t, p)[0].decode(errors="ignore") for t, p in zip(part.column("text").to_pylist(), part.column("places").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    dealt, places = repeated(docs)
    joined = dealt.join(places, ["doc", "part"], "left").select("row", "text", "places")
    out = joined.mapInArrow(run, joined.select("row", "text").schema)
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
