"""Quality selection by importance resampling.

Hashed word and word-pair counts make two generative models: one of target texts, one of all raw texts. A document's log
importance is the sum over its features of the log ratio of their probabilities. Adding independent Gumbel noise and
keeping the greatest k draws documents without replacement in proportion to their importance.

Counts are gathered over all documents: every task sums its own into BUCKETS numbers, Spark sums the tasks'. Only those
2 * BUCKETS sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_words, materialize, rolling

BUCKETS = 1 << 16
#: Target ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Value ranges that are counted at once to find the k-th greatest key, and rows that are then ranked in one task.
RANGES, RANKED = 1024, 50_000


def features(texts: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """lo, hi, bucket of every feature of texts lo..hi, and whose it is: words, then pairs of neighbours."""
    for w in hashed_words(texts, lower=True):
        lengths = np.diff(w.first)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        pairs = rolling(w.hashes, 2)
        at = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, int)
        bucket = np.concatenate([w.hashes, pairs[at]]) % np.uint64(buckets)
        yield w.lo, w.hi, bucket.astype(np.int64), np.concatenate([owner, owner[at]])


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for b in batches:
            target = np.asarray(b.column("target").to_numpy(zero_copy_only=False), bool)
            for lo, hi, bucket, owner in features(b.column("text"), buckets):
                sums[1] += np.bincount(bucket, minlength=buckets)
                sums[0] += np.bincount(bucket[target[lo:hi][owner]], minlength=buckets)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "target_n": pa.array(sums[0][at]), "raw_n": pa.array(sums[1][at])})

    return run


def feature_ratios(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of every bucket, add-one smoothed, from (text, target) of all rows."""
    sums = docs.select("text", "target").mapInArrow(_count(buckets), "bucket long, target_n long, raw_n long").groupBy("bucket").agg(F.sum("target_n").alias("t"), F.sum("raw_n").alias("r")).toPandas()
    t, r = np.ones(buckets), np.ones(buckets)
    t[sums["bucket"].to_numpy(int)] += sums["t"].to_numpy(float)
    r[sums["bucket"].to_numpy(int)] += sums["r"].to_numpy(float)
    return np.log(t / t.sum()) - np.log(r / r.sum())


def _weigh(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, bucket, owner in features(b.column("text"), buckets):
                weight = np.bincount(owner, shared.value[bucket], hi - lo) if len(owner) else np.zeros(hi - lo)
                n = np.bincount(owner, minlength=hi - lo)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(weight)], ["doc_id", "n_features", "log_weight"])

    return run


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise of a key: the same for the same key and seed."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double")
    return -F.log(-F.log((bits + 0.5) / F.lit(float(1 << 53))))


def top_share(rows: DataFrame, key: str, ties: list[str], k: int) -> DataFrame:
    """Adds `selected` to the k rows of greatest key (then least ties) without a global sort.

    Counts of keys in RANGES ranges of value find the range that holds the k-th, which is cut again until it holds at most RANKED
    rows, or rows of one key: those are told apart by the next tie in the same way. Only at most RANKED rows are ranked, or rows alike in key and ties. `rows` are
    read several times.
    """
    keys = [F.col(key), *[F.coalesce(-F.col(t).cast("double"), F.lit(math.inf)) for t in ties]]
    above, inside, left, n = F.lit(False), F.lit(True), k, rows.count()
    if not n or k <= 0:
        return rows.withColumn("selected", F.lit(False))
    for c in keys:
        low, high, n, left, inside, higher = _narrowed(rows, c, inside, left)
        above = above | higher
        if n <= RANKED:
            break
    edge = rows.where(inside).withColumn("selected", F.row_number().over(Window.orderBy(*[F.desc(c) for c in keys])) <= left)
    return edge.unionByName(rows.where(~inside).withColumn("selected", above))


def _narrowed(rows: DataFrame, c: Column, inside: Column, left: int) -> tuple:
    """(low, high, n, left, inside, higher): the values of c between which the left-th greatest of the rows inside lies, how many rows those are and how many of them
    are still to select, and the conditions of being there and of being above."""
    low, high = rows.where(inside).agg(F.min(c), F.max(c)).first()
    top, here = high, inside
    while True:
        n = rows.where(here).count()
        width = (high - low) / RANGES
        if n <= RANKED or low == high:
            break
        if math.isinf(high):  # missing ids
            at = (c == F.lit(high)).cast("int")
        elif width <= math.ulp(max(abs(low), abs(high))):  # too few values between for ranges
            at = (c > F.lit(low)).cast("int")
        else:
            at = F.least(F.lit(RANGES - 1), F.floor((c - F.lit(low)) / F.lit(width)))
        counts = {r["at"]: r for r in rows.where(here).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).collect()}
        for i in sorted(counts, reverse=True):
            if left <= counts[i]["n"]:
                break
            left -= counts[i]["n"]
        low, high = counts[i]["low"], counts[i]["high"]
        here = inside & c.between(low, high)
    return low, high, n, left, here, (inside & (c > F.lit(high))) if high != top else F.lit(False)


def importance_resample(docs: DataFrame, target_ids: DataFrame, share: float = 0.5, buckets: int = BUCKETS, seed: int = 17) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key, selected of every row.

    `target_ids` (doc_id) names the documents of the target text. log_weight is the sum of the log ratios over a text's features; null
    and wordless texts weigh nothing and come last (gumbel_key about -1e9). `share` of all rows is selected; ties go to the smaller
    doc_id. A null doc_id is never a target; repeated rows draw the same noise and are each a row of the result. An
    empty table gives no rows; without target documents the weights are those of an even model.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    marks = materialize(marks, "importance-target")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks  # else texts move to their marks
    ratios = feature_ratios(base.join(marks, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    weights = base.mapInArrow(_weigh(shared, buckets), "doc_id long, n_features long, log_weight double")
    key = gumbel(F.col("doc_id"), seed) + F.when(F.col("n_features") > 0, F.col("log_weight")).otherwise(F.lit(-1e9))
    rows = materialize(weights.withColumn("gumbel_key", key).withColumn("row", F.monotonically_increasing_id()), "importance-weights")
    return top_share(rows, "gumbel_key", ["doc_id", "row"], round(share * rows.count())).drop("row")
