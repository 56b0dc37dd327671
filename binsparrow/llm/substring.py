"""Exact repeated passages by fixed-block anchors.

Every document's words are an index of non-overlapping blocks of BLOCK words and a probe of every rolling window of
BLOCK words. A passage of `window` >= 2 * BLOCK words that two documents share holds a whole block of the one, so a probe of the other
hits it. Hits are extended: around hit windows and hit blocks, all runs of `window` words are compared across documents,
and neighbouring runs that an earlier document also has make the maximal repeats, which are removed.

Windows travel packed, thousands to a row, in buckets of their hashes; a bucket's index comes first and its probes stream past
it, so that memory is bounded by a bucket's blocks. Buckets grow in number with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix, rolling, text_bytes

BLOCK = 25
#: Windows that a bucket should hold.
BUCKET_WINDOWS = 4 << 20
NO_ID = (1 << 63) - 1
PACKED = "bucket int, side int, docs binary, counts binary, places binary, hashes binary"


def _pack(x: np.ndarray) -> bytes:
    """Byte planes of an integer array: high bytes, mostly equal, compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    width = int(dtype[-1])
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _packed_rows(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, buckets: int, side: int, dtype: str, values: np.ndarray | None = None) -> Iterator[dict]:
    """A row for each bucket; entries keep the order of (document, place). docs: an id for each entry. values: in place of the hashes."""
    values = hashes if values is None else values
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint32), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b] : cuts[b + 1]]
        d, p = docs[at], places[at]
        new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        step = p.astype(np.uint32)
        step[1:] -= p[:-1].astype(np.uint32)
        step[new] = p[new]
        yield {"bucket": int(b), "side": side, "docs": _pack(d[new]), "counts": _pack(np.diff(np.append(new, len(d))).astype("<u4")), "places": _pack(step), "hashes": _pack(values[at].astype(dtype))}


def _entries(row: dict, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashes, docs, places of a packed row."""
    d, n, step = _unpack(row["docs"], "<i8"), _unpack(row["counts"], "<u4").astype(np.int64), _unpack(row["places"], "<u4").astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(n) - n
    places = total - np.repeat(total[first] - step[first], n)
    return _unpack(row["hashes"], dtype) if dtype else places, np.repeat(d, n), places


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_PACKED = pa.schema([("bucket", pa.int32()), ("side", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("hashes", pa.binary())])


def _inside(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k words that lie inside one text, given where the texts' words begin."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    return np.repeat(first[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _windows(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for w in hashed_words(b.column("text")):
                lengths = np.diff(w.first)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                at = _inside(w.first, BLOCK)
                at = at[lengths[owner[at]] >= window]
                if not len(at):
                    continue
                hashes, doc = rolling(w.hashes, BLOCK)[at], owner[at]
                places = at - w.first[doc]
                named = ids[w.lo + doc]
                block = places % BLOCK == 0
                rows = [*_packed_rows(hashes[block], named[block], places[block], buckets, 0, "<u4"), *_packed_rows(hashes, named, places, buckets, 1, "<u4")]
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64], _PACKED)

    return run


_HITS = pa.schema([("id", pa.int64()), ("places", pa.binary()), ("hashes", pa.binary())])


def _reply(docs: np.ndarray, places: np.ndarray, buckets: int, hashes: np.ndarray | None = None) -> list[dict]:
    """Places of documents, packed for their way back in as many groups of documents as there are buckets."""
    if not len(docs):
        return []
    group = mix(docs.astype(np.int64).view(np.uint64)) << np.uint64(32)  # the packing deals by the high half
    if hashes is None:
        return [r | {"hashes": b""} for r in _packed_rows(group, docs, places, buckets, 0, "<u4")]
    return [*_packed_rows(group, docs, places, buckets, 0, "<u8", hashes)]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: one row for each document."""
    group, held = None, []

    def close() -> pa.RecordBatch:
        if not held:
            return _batch([], _HITS)
        d, p, h = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((p, d))
        d, p, h = d[order], p[order].astype("<u4"), h[order] if len(h) else h
        cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]]))
        places, hashes = ([x[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)] for x in (p, h))
        return pa.RecordBatch.from_arrays([pa.array(d[cuts[:-1]]), pa.array(places, pa.binary()), pa.array(hashes, pa.binary())], schema=_HITS)

    for b in batches:
        for row in b.to_pylist():
            if row["bucket"] != group:
                yield close()
                group, held = row["bucket"], []
            _, d, p = _entries(row, None)
            held.append((d, p, _unpack(row["hashes"], "<u8") if row["hashes"] else np.zeros(0, "<u8")))
    yield close()


def _probe(buckets: int):
    """Rows sorted by (bucket, side): windows that a smaller document's block equals, and blocks that a larger one's window equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, index, hit, found, n_found = None, [], None, None, [], 0

        def flush() -> list[dict]:
            d, p = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.lexsort((p, d))
            found.clear()
            return _reply(d[order], p[order], buckets)

        def close() -> list[dict]:
            if index is not None:
                keys, _, (h, d, p) = index
                used = hit[np.searchsorted(keys, h)]
                found.append((d[used], p[used]))
            return flush()

        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                if row["bucket"] != bucket:
                    out += close()
                    bucket, blocks, index = row["bucket"], [], None
                if row["side"] == 0:
                    blocks.append(_entries(row, "<u4"))
                    continue
                if index is None and not blocks:
                    continue
                if index is None:
                    h, d, p = (np.concatenate(x) for x in zip(*blocks, strict=True))
                    order = np.lexsort((d, h))
                    h, d, p = h[order], d[order], p[order]
                    keys, first, n = np.unique(h, return_index=True, return_counts=True)
                    least = d == np.repeat(d[first], n)
                    index, hit, blocks = (keys, d[first], (h[least], d[least], p[least])), np.zeros(len(keys), bool), []
                h, d, p = _entries(row, "<u4")
                k = np.minimum(np.searchsorted(index[0], h), len(index[0]) - 1)
                same = (index[0][k] == h) & (index[1][k] < d)
                hit[k[same]] = True
                found.append((d[same], p[same]))
                n_found += int(same.sum())
                if n_found > BUCKET_WINDOWS // 4:
                    out += flush()
                    n_found = 0
            yield _batch(out, _PACKED)
        yield _batch(close(), _PACKED)

    return run


def _extend(window: int, buckets: int):
    """Of each text with hits, the runs of `window` words that hold a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column("places").to_pylist()
            ids = b.column("id").to_numpy()
            for w in hashed_words(b.column("text")):
                if not len(w.hashes):
                    continue
                whole = rolling(w.hashes, window)
                marks = np.zeros(len(w.hashes) + 2, np.int32)
                for i in range(w.lo, w.hi):
                    s = w.of(i)
                    for packed in hits[i] or ():
                        p = np.frombuffer(packed, "<u4").astype(np.int64)
                        p = p[p + BLOCK <= s.stop - s.start] + s.start
                        np.add.at(marks, np.maximum(p - (window - BLOCK), s.start), 1)
                        np.add.at(marks, p + 1, -1)
                near = np.cumsum(marks[:-2]) > 0
                at = _inside(w.first, window)
                at = at[near[at]]
                if not len(at):
                    continue
                doc = np.searchsorted(w.first, at, "right") - 1
                rows = [*_packed_rows(whole[at], ids[w.lo + doc], at - w.first[doc], buckets, 0, "<u8")]
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64], _PACKED)

    return run


def _repeats(buckets: int):
    """Rows sorted by bucket: runs that a smaller document has too. Of each run only the least document so far is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, fresh = None, [], 0

        def settle() -> list[dict]:
            if not held:
                return []
            h, d, p = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((d, h))
            h, d, p = h[order], d[order], p[order]
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            later = d > np.repeat(d[first], n)
            held[:] = [(h[~later], d[~later], p[~later])]
            h, d, p = h[later], d[later], p[later]
            order = np.lexsort((p, d))
            return _reply(d[order], p[order], buckets, h[order])

        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                if row["bucket"] != bucket:
                    out += settle()
                    bucket, fresh = row["bucket"], 0
                    held.clear()
                held.append(_entries(row, "<u8"))
                fresh += len(held[-1][0])
                if fresh > BUCKET_WINDOWS // 4:
                    out += settle()
                    fresh = 0
            yield _batch(out, _PACKED)
        yield _batch(settle(), _PACKED)

    return run


def _cut(window: int, texts: bool):
    """What stays of each row: figures and spans, or the text itself beside the row's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, known = b.column("places").to_pylist(), b.column("hashes").to_pylist()
            for w in hashed_words(b.column("text")):
                counts, removed, spans, left = [], [], [], []
                whole = rolling(w.hashes, window) if any(found[w.lo : w.hi]) else None
                raw = w.data.tobytes()
                for i in range(w.lo, w.hi):
                    s = w.of(i)
                    n = s.stop - s.start
                    marks = np.zeros(n + 1, np.int32)
                    for packed, run_hashes in zip(found[i] or (), known[i] or (), strict=True):
                        p, h = np.frombuffer(packed, "<u4").astype(np.int64), np.frombuffer(run_hashes, "<u8")
                        p, h = p[p + window <= n], h[p + window <= n]
                        p = p[whole[s.start + p] == h]  # other rows of this doc_id have places too
                        np.add.at(marks, p, 1)
                        np.add.at(marks, p + window, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                    counts.append(n)
                    removed.append(int(gone.sum()))
                    spans.append([{"start": int(x), "stop": int(y)} for x, y in edges])
                    lo, hi = int(w.cuts[i - w.lo]), int(w.cuts[i - w.lo + 1])
                    if texts:  # all but the bytes from a removed run's first word to the next word that stays
                        starts = np.append(w.starts[s], hi)
                        stay = [lo, *starts[edges].ravel().tolist(), hi]
                        left.append(b"".join(raw[x:y] for x, y in zip(stay[::2], stay[1::2], strict=True)) if len(edges) else raw[lo:hi])
                    else:
                        words = raw[lo:hi].split()
                        kept = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g] if len(edges) else words)
                        left.append(hashlib.sha256(kept).hexdigest())
                part = b.slice(w.lo, w.hi - w.lo)
                spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                last = pa.array(left, pa.binary()).cast(pa.string()) if texts else pa.array(left, pa.string())
                columns = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), spans, last]
                yield pa.RecordBatch.from_arrays([part.column("rest"), *columns], ["rest", "n_words", "n_removed", "spans", "left"])

    return run


def _found(docs: DataFrame, window: int) -> DataFrame:
    """(id, text, places): every row's runs of `window` words that a smaller document has too."""
    buckets = max(1, text_bytes(docs) // 6 // BUCKET_WINDOWS)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    dealt = lambda rows, *order: rows.repartition("bucket").sortWithinPartitions("bucket", *order)
    replies = lambda rows: dealt(rows).mapInArrow(_gather, "id long, places binary, hashes binary").groupBy("id").agg(F.collect_list("places").alias("places"), F.collect_list("hashes").alias("hashes"))
    hits = replies(dealt(base.mapInArrow(_windows(window, buckets), PACKED), "side").mapInArrow(_probe(buckets), PACKED))
    near = base.join(hits, "id", "left").where("places IS NOT NULL").select("id", "text", "places")
    return replies(dealt(near.mapInArrow(_extend(window, buckets), PACKED)).mapInArrow(_repeats(buckets), PACKED))


def _judged(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    if window < 2 * BLOCK:
        raise ValueError(f"a window of {window} words need not hold a block of {BLOCK}")
    rest = [F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest")] if texts else []
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"), *rest)
    met = base.join(_found(docs, window), "id", "left")
    if not texts:
        met = met.withColumn("rest", F.struct(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")))
    met = met.select("text", "places", "hashes", "rest")
    return met.mapInArrow(_cut(window, texts), f"rest {met.schema['rest'].dataType.simpleString()}, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, left string")


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges removed), kept_sha256 (of the words that stay, one space between) of every row.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if some window of `window` words over it also starts in a document with a smaller
    doc_id; windows are judged on the input. Null texts have no words. A null doc_id is larger than all others; rows that
    repeat a doc_id are no smaller than each other. Words and windows are equal if their 64-bit hashes are. Other columns are ignored; an empty table gives no rows.
    """
    return _judged(docs, window, texts=False).select("rest.doc_id", "n_words", "n_removed", "spans", F.col("left").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """The documents with their repeated passages cut out of `text` (white space elsewhere stays), other columns as they came.

    Documents of which nothing is left go; wordless texts stay, null ones as empty.
    """
    out = _judged(docs, window, texts=True).where("n_words = 0 OR n_removed < n_words")
    return out.select(*[(F.col("left") if c == "text" else F.col("rest")[c]).alias(c) for c in docs.columns])
