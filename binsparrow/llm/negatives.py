"""Hard-negative mining by norm-bucketed search.

Rows are range-sorted by falling length and cut into buckets; a bucket knows the length of its longest row. Anchors meet the buckets in waves, the
longest rows first, each wave GROWTH times as many buckets as the one before. By Cauchy and Schwarz a row's score with an anchor is at most the product
of their lengths, so an anchor takes no part in a bucket whose longest row cannot reach what it needs: in the search for positives the score of
the k-th one found so far; in the search for negatives the least, over its windows, of the window's lower limit and the running k-th score inside it. Lengths fall
from bucket to bucket, so an anchor that a bucket cannot serve needs none after it.

An anchor and a bucket meet in a tile: one block of anchors with one bucket, both bounded. Only each anchor's best leave a tile. Where all lengths
are alike (normalised vectors), or windows begin at 0, nothing can be pruned: every anchor then meets every row, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a bucket (two to this power) and, about, of a block of anchors.
BUCKET_BITS, ANCHORS = 13, 8192
#: Buckets of a wave, against the wave before; the first has one.
GROWTH = 8
#: Rows of one partition of the sorted table.
PARTITION_ROWS = 1 << 17
#: Scores held at once in a tile.
SCORES = 1 << 21
#: Sums of products below this are whole in double precision; squared lengths from the second on have scores beyond 64 bits.
EXACT, MOST = float(1 << 53), float(1 << 62)


def quantised(table: DataFrame, scale: float = 256) -> DataFrame:
    """rows(row, vec_id, label, vec, square): whole-number vectors floor(scale * x) of the rows that take part, and their squared lengths."""
    x = F.col("embedding").cast("array<double>")
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.lit(float(scale)) * v).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MOST))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    vec = F.transform("x", lambda v: F.floor(v))
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    return rows.select("row", "vec_id", "label", vec.alias("vec")).withColumn("square", square).where(F.col("square") < MOST)


def bucketed(rows: DataFrame) -> DataFrame:
    """The rows by falling length, with `bucket`: buckets of later numbers hold no longer rows. Equal lengths are split by row."""
    parts = max(1, -(-rows.count() // PARTITION_ROWS))
    ranged = rows.repartitionByRange(parts, F.desc("square"), "row").sortWithinPartitions(F.desc("square"), "row")
    return materialize(ranged.withColumn("bucket", F.shiftright(F.monotonically_increasing_id(), BUCKET_BITS)), "negatives-rows")


def _matrix(column: pa.ChunkedArray, width: int, dtype: type) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width), dtype)
    size = column.value_lengths().to_numpy()
    out[np.arange(width)[None] < size[:, None]] = column.flatten().to_numpy()
    return out


def _best(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores where ok, ties to the lesser column, in that order."""
    least = np.iinfo(np.int64).min if score.dtype == np.int64 else -np.inf
    held = np.where(ok, score, least)
    if score.shape[1] > k:
        ok = ok & (held >= np.partition(held, -k, axis=1)[:, -k][:, None])
    r, c = np.nonzero(ok)
    order = np.lexsort((c, -held[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


FOUND = "anchor long, window long, row long, vec_id long, score long"


def _tile(k: int, low: int | None, exact: bool):
    """Of one bucket (side 1) the k best rows for every anchor of a block (side 0): of its own label where low is None, else for each window."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        b = b.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls come last: columns in the order of ties
        out: dict[str, list] = {c: [] for c in ("anchor", "window", "row", "vec_id", "score")}
        if a.num_rows and b.num_rows:
            width = max(t.column("vec").combine_chunks().value_lengths().to_numpy().max() for t in (a, b))
            dtype = np.float64 if exact else np.int64
            x, y = (_matrix(t.column("vec"), width, dtype) for t in (a, b))
            names, rows, ids = a.column("row").to_numpy(), b.column("row").to_numpy(), b.column("vec_id").combine_chunks()
            same = a.column("label").to_numpy(), b.column("label").to_numpy()
            windows = a.column("windows").to_pylist()
            step = max(1, SCORES // b.num_rows)
            for at in range(0, a.num_rows, step):
                end = min(at + step, a.num_rows)
                score = x[at:end] @ y.T
                alike = same[0][at:end, None] == same[1][None]
                asked = max((len(w) for w in windows[at:end]), default=0) if low is not None else 1
                for j in range(asked):
                    if low is None:
                        top, ok = [0] * (end - at), alike & (names[at:end, None] != rows[None])
                    else:
                        top = [w[j] if j < len(w) else -1 for w in windows[at:end]]
                        ok = ~alike & (score <= np.array(top, dtype)[:, None]) & (score >= np.array([_lower(t, low) if t >= 0 else 0 for t in top], dtype)[:, None])
                    r, c = _best(score, ok, k)
                    out["anchor"].append(names[at + r])
                    out["window"].append(np.array(top, np.int64)[r])
                    out["row"].append(rows[c])
                    out["vec_id"].append(ids.take(pa.array(c)))
                    out["score"].append(score[r, c].astype(np.int64))
        flat = {n: pa.chunked_array([pa.array(v, pa.int64()) for v in parts], pa.int64()) for n, parts in out.items()}
        return pa.table(flat)

    return run


def _lower(score: int, low: int) -> int:
    """The least whole number n with 100 * n >= low * score."""
    return -(-low * score // 100)


def _lower_column(low: int) -> Column:
    """_lower of the column `window`, which is not negative."""
    rest = F.col("window") % 100
    return F.expr("`window` div 100") * low + F.ceil(rest * low / 100).cast("long")


def _dealt(numbers: np.ndarray, tops: np.ndarray, lo: int, hi: int):
    """An anchor with each bucket of lo..hi that can serve it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            need = b.column("need").to_numpy()
            reach = np.searchsorted(-tops * (1 + 1e-9), -need, "right")  # buckets whose longest row is long enough
            times = np.clip(np.minimum(reach, hi) - lo, 0, None)
            which = np.repeat(np.arange(len(need)), times)
            place = lo + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            for at in range(0, len(which), 10_000):
                part = b.take(pa.array(which[at : at + 10_000]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers[place[at : at + 10_000]], pa.int64())], [*part.schema.names, "bucket"])

    return run


def _search(rows: DataFrame, anchors: DataFrame, buckets: list[tuple[int, float]], k: int, low: int | None, name: str) -> DataFrame:
    """(anchor, window, row, vec_id, score): each anchor's k best rows, or each of its windows'.

    anchors(row, label, vec, square, windows, block). Waves go on while some anchor needs a further bucket.
    """
    spark, lo, size = rows.sparkSession, 0, 1
    numbers, tops = np.array([b for b, _ in buckets], np.int64), np.array([t for _, t in buckets], float)
    exact = not len(tops) or float(tops.max()) < EXACT
    found = spark.createDataFrame([], FOUND)
    limits = anchors.select(F.col("row").alias("anchor"), (F.explode("windows") if low is not None else F.lit(0).cast("long")).alias("window"))
    while lo < len(buckets):
        hi = min(lo + size, len(buckets))
        held = found.groupBy("anchor", "window").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        least = F.when(F.col("n") >= k, F.col("kth"))
        if low is not None:
            least = F.greatest(_lower_column(low), least)
        need = limits.join(held, ["anchor", "window"], "left").groupBy(F.col("anchor").alias("row")).agg(F.min(F.coalesce(least, F.lit(0))).alias("least"))
        length = F.greatest(F.col("least"), F.lit(0)).cast("double")
        ask = anchors.join(need, "row").withColumn("need", F.when(length > 0, length * length / F.col("square")).otherwise(0.0)).drop("least", "square")
        ask = ask.select("row", "label", "vec", "windows", "block", "need").mapInArrow(_dealt(numbers, tops, lo, hi), "row long, label long, vec array<long>, windows array<long>, block long, need double, bucket long")
        ask = materialize(ask, f"{name}-asked")
        tiles = ask.select("bucket", "block").distinct()
        left = ask.select("bucket", "block", F.lit(0).alias("side"), "row", F.lit(None).cast("long").alias("vec_id"), "label", "vec", "windows")
        right = rows.join(tiles, "bucket").select("bucket", "block", F.lit(1).alias("side"), "row", "vec_id", "label", "vec", F.lit(None).cast("array<long>").alias("windows"))
        new = left.unionByName(right).groupBy("bucket", "block").applyInArrow(_tile(k, low, exact), FOUND)
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        found = materialize(found.unionByName(new).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"), name)
        lo, size = hi, size * GROWTH
    return found


def hard_negatives(table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose vec_id `every` divides.

    table(vec_id, label, embedding); other columns are ignored. Scores are inner products of floor(scale * x). An anchor's positives are the
    `positives` best other rows of its label; the negatives of a positive are the `negatives` best rows of other labels that score from low percent of
    the positive's score up to that score. Ties go to the smaller vec_id, null last. A negative positive score leaves an empty window.

    Rows with a null label or vector, or with null or non-finite components, take no part; nor do vectors so long that scores exceed 64 bits. Shorter vectors
    count as if zeros followed. Rows that repeat a vec_id are rows of their own. An anchor without positives, and a positive without
    negatives, gives no row; an empty table none at all.
    """
    rows = bucketed(quantised(table, scale))
    buckets = [(r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("square").alias("top")).orderBy("bucket").collect()]  # one in 2 ** BUCKET_BITS rows
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // ANCHORS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    good = _search(rows, asked.withColumn("windows", F.lit(None).cast("array<long>")), buckets, positives, None, "negatives-positives")
    windows = good.where(F.col("score") >= 0).groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("windows"))
    bad = _search(rows, asked.join(windows, "row"), buckets, negatives, low, "negatives-found")
    named = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = good.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    ranked = bad.withColumn("rank", rank).select("anchor", F.col("window").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(ranked, ["anchor", "positive_score"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle_sql() -> str:
    """op13's contract over `embeddings`."""
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5"""
