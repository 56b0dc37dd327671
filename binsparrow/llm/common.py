"""What several corpus operators share: shared storage, words and hashes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put_file(path: str, write) -> None:
    """Write under a name of this attempt, then move: retried and doubled tasks leave whole files."""
    system, at = open_path(path)
    context = TaskContext.get()
    part = f"{at}.{context.taskAttemptId() if context else 0}.part"
    system.create_dir(os.path.dirname(at), recursive=True)
    with system.open_output_stream(part) as out:
        write(out)
    system.move(part, at)


def map_file(path: str, dtype: str) -> np.ndarray:
    """A file's numbers: mapped into memory where the store is mounted, else read."""
    system, at = open_path(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.asarray(np.memmap(at, dtype, "r")) if os.path.getsize(at) else np.zeros(0, dtype)
    with system.open_input_stream(at) as f:
        return np.frombuffer(f.read(), dtype)


_CACHE: list = []


def only_cache(owner: str, drop) -> None:
    """Say what a worker process keeps between tasks. What another operator has kept before is dropped, as processes outlive operators."""
    if not _CACHE or _CACHE[0] != owner:
        if _CACHE:
            _CACHE[1]()
            pa.default_memory_pool().release_unused()
        _CACHE[:] = owner, drop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all windows of k consecutive entries, by doubling: log2(k) passes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mask = (1 << 64) - 1
    power, width, span, out, done = base, h, 1, None, 0
    while True:
        if k & span:
            part = width[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += span
        if done == k:
            return mix(out)
        width = width[:-span] * np.uint64(power) + width[span:]
        power, span = power * power & mask, span * 2


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column: one narrow pass, used to size partitions."""
    from pyspark.sql import functions as F

    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


# ---- whole batches of texts as word hashes -----------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Text bytes hashed at once; a longer text goes whole.
SLICE_BYTES = 2 << 20


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_ODD, _UNDO)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x, dtype=np.uint64)
    return _POWERS


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts lo..hi of a batch: hashes, byte places, and where each text's words begin."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, cuts: np.ndarray, lower: bool):
        self.lo, self.hi, self.data, self.cuts = lo, hi, data, cuts
        solid = ~_SPACE[data]
        inner = cuts[:-1][cuts[:-1] < len(data)]
        before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
        before[inner] = False
        after = np.concatenate([solid[1:], [False]]) if len(data) else solid
        after[inner[inner > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        up, down = _powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], dtype=np.uint64)])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.first = np.searchsorted(self.starts, cuts)  # of each text; one more at the end

    def of(self, k: int) -> slice:
        return slice(self.first[k - self.lo], self.first[k - self.lo + 1])


def hashed_words(texts, lower: bool = False):
    """Words of an Arrow column of texts (null: none), in slices of about SLICE_BYTES.

    A word's hash is a 64-bit polynomial of random byte codes, found for all words at once from one running sum.
    """
    only_cache("words", lambda: None)
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield Words(at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], lower)
        at = end
