"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back by memory map.

A written corpus is a folder with, for every partition p of the doc_id order, ``ids-p.bin`` (all ids, little-endian
unsigned integers), ``docs-p.bin`` (doc_ids, signed 64-bit; null as the least value), ``offsets-p.bin`` (unsigned
64-bit, documents + 1 entries, counted over the whole corpus) and one ``manifest.json``.

Nulls and edges: null text counts as empty (only the end id); null doc_ids come first; equal doc_ids keep one run
each, in unspecified order among themselves; other columns are ignored; an empty table makes an empty manifest.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_file, open_path, put_file, shared_path, text_bytes
from .tokens import encoder

NO_DOC = np.iinfo(np.int64).min
#: Text bytes a partition should hold.
PARTITION_BYTES = 32 << 20


def _write(path: str, tokenizer: str, dtype: str, end_id: int):
    end, width = np.array([end_id], dtype).tobytes(), int(dtype[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by doc_id, a range of them in each partition: one file a task."""
        e, pid, docs, lengths = encoder(tokenizer, dtype), TaskContext.get().partitionId(), [], []

        def write(out) -> None:
            for b in batches:
                docs.append(b.column("doc_id").fill_null(NO_DOC).to_numpy())
                for ids in e.encode_batch(b.column("text")):
                    out.write(ids + end)
                    lengths.append(len(ids) // width + 1)

        put_file(f"{path}/ids-{pid:06d}.bin", write)
        put_file(f"{path}/docs-{pid:06d}.bin", lambda o: o.write(np.concatenate([np.zeros(0, "<i8"), *docs]).astype("<i8").tobytes()))
        put_file(f"{path}/lengths-{pid:06d}.bin", lambda o: o.write(np.array(lengths, "<i8").tobytes()))
        made = [[pid], [len(lengths)], [sum(lengths)]] if lengths else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.int64())], ["pid", "n_docs", "n_tokens"])

    return run


def _place(path: str, base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turn lengths into offsets over the whole corpus."""
        for b in batches:
            for i in b.column("id").to_pylist():
                pid = sorted(base)[i]
                system, at = open_path(f"{path}/lengths-{pid:06d}.bin")
                with system.open_input_stream(at) as f:
                    lengths = np.frombuffer(f.read(), "<i8")
                offsets = base[pid] + np.concatenate([[0], np.cumsum(lengths)])
                put_file(f"{path}/offsets-{pid:06d}.bin", lambda o, x=offsets: o.write(x.astype("<u8").tobytes()))
            yield b

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int = 1 << 16) -> dict:
    """Encode (doc_id, text) and write the files; returns the manifest. Ids take two bytes if the vocabulary allows.

    Texts are shuffled once, to ranges of doc_id, each a task; rows that repeat a doc_id may be dealt to several. Each range's place in the
    corpus comes from prefix sums over the ranges.
    """
    spark = docs.sparkSession
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = max(1, -(-text_bytes(docs) // PARTITION_BYTES))
    system, at = open_path(path)
    system.create_dir(at, recursive=True)
    ranges = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    made = sorted(map(tuple, ranges.select("doc_id", "text").mapInArrow(_write(path, tokenizer, dtype, end_id), "pid int, n_docs long, n_tokens long").collect()))
    base, total = {}, 0
    for p, _, tokens in made:
        base[p] = total
        total += tokens
    if made:
        spark.range(0, len(made), 1, len(made)).mapInArrow(_place(path, base), "id long").count()
    manifest = {"dtype": dtype, "end_id": end_id, "n_tokens": total, "parts": [{"pid": p, "n_docs": d, "n_tokens": t, "base": base[p]} for p, d, t in made]}
    put_file(f"{path}/manifest.json", lambda o: o.write(json.dumps(manifest).encode()))
    return manifest


def _read(path: str, pids: list[int], dtype: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                p = pids[i]
                ids, docs, offsets = (map_file(f"{path}/{name}-{p:06d}.bin", kind) for name, kind in (("ids", dtype), ("docs", "<i8"), ("offsets", "<u8")))
                local = (offsets - offsets[0]).astype(np.int64)
                for at in range(0, len(docs), 2000):
                    end = min(at + 2000, len(docs))
                    runs = [np.asarray(ids[local[k] : local[k + 1]], "<u4") for k in range(at, end)]
                    names = np.asarray(docs[at:end])
                    columns = {
                        "doc_id": pa.array(names, pa.int64(), mask=names == NO_DOC),
                        "start": pa.array(np.asarray(offsets[at:end], np.int64)),
                        "n_tokens": pa.array([len(r) for r in runs], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(r) for r in runs], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([r.astype(np.int64) for r in runs], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a written corpus: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    system, at = open_path(f"{path}/manifest.json")
    with system.open_input_stream(at) as f:
        manifest = json.loads(f.read())
    pids = [p["pid"] for p in manifest["parts"]]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not pids:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(pids), 1, len(pids)).mapInArrow(_read(path, pids, manifest["dtype"], with_ids), schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int = 50257) -> DataFrame:
    """Write the corpus to the shared folder and read it back."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, vocabulary)
    return read_token_files(docs.sparkSession, path)
