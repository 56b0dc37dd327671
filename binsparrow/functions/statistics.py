"""Distribution distances, ranks and probabilities as Column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hart's rational approximation of the normal distribution's tail (double precision).
_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(coefficients, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """Phi(x), to about 1e-14; 0 or 1 beyond 7 standard deviations."""
    a = F.abs(x)
    tail = F.when(a > 7, F.lit(0.0)).otherwise(F.exp(-a * a / 2) * _horner(_TOP, a) / _horner(_BOTTOM, a))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    a = f"abs({x})"

    def horner(c):
        out = repr(c[0]) + "::DOUBLE"
        for v in c[1:]:
            out = f"({out} * {a} + {v!r}::DOUBLE)"
        return out

    tail = f"CASE WHEN {a} > 7 THEN 0 ELSE exp(-{a} * {a} / 2) * {horner(_TOP)} / {horner(_BOTTOM)} END"
    return f"(CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END)"


def normal_overlap(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """1 - shared area of two normal distributions: the area between their crossing points."""
    d = v2 - v1
    root = F.sqrt(F.greatest(F.lit(0.0), v1 * v2 * ((m1 - m2) * (m1 - m2) + d * F.log(v2 / v1))))
    near = F.abs(d) < 1e-4
    safe = F.when(near, 1.0).otherwise(d)
    middle = m1 * v2 - m2 * v1
    k1 = F.when(near, (m1 + m2) / 2).otherwise((middle - root) / safe)
    k2 = F.when(near, (m1 + m2) / 2).otherwise((middle + root) / safe)
    # lambda variables hold each crossing point and each probability once
    at = lambda k: F.transform(F.array((k - m1) / F.sqrt(v1), (k - m2) / F.sqrt(v2)), normal_cdf)
    area = lambda p: F.when(near, F.abs(p[0][0] - p[0][1])).otherwise(F.abs(p[1][0] - p[0][0] + p[0][1] - p[1][1]))
    return F.transform(F.array(F.transform(F.array(k1, k2), at)), area)[0]


def depth_distance(m1: Column, v1: Column, m2: Column, v2: Column, min_cv: float = 1.0) -> Column:
    """Distance of one sample's depths; null where neither mean exceeds min_cv."""
    a, b = F.greatest(m1, F.lit(1e-6)), F.greatest(m2, F.lit(1e-6))
    d = F.when(a == b, F.lit(0.0)).otherwise(normal_overlap(a, F.greatest(v1, F.lit(1.0)), b, F.greatest(v2, F.lit(1.0))))
    return F.when((m1 > min_cv) | (m2 > min_cv), F.least(F.greatest(d, F.lit(1e-6)), F.lit(1 - 1e-6)))


def normal_cdfs(x: np.ndarray) -> np.ndarray:
    """normal_cdf of an array."""
    a = np.abs(x)
    tail = np.where(a > 7, 0.0, np.exp(-a * a / 2) * _horner(_TOP, a) / _horner(_BOTTOM, a))
    return np.where(x > 0, 1 - tail, tail)


def depth_distances(m1: np.ndarray, v1: np.ndarray, m2: np.ndarray, v2: np.ndarray, min_cv: float = 1.0) -> np.ndarray:
    """depth_distance of arrays; nan where neither mean exceeds min_cv. As in SQL, nan is the greatest number and equals itself."""
    with np.errstate(all="ignore"):
        a, b, v1, v2 = np.maximum(m1, 1e-6), np.maximum(m2, 1e-6), np.maximum(v1, 1.0), np.maximum(v2, 1.0)
        d = v2 - v1
        root = np.sqrt(np.maximum(0.0, v1 * v2 * ((a - b) * (a - b) + d * np.log(v2 / v1))))
        near, middle = np.abs(d) < 1e-4, a * v2 - b * v1
        safe = np.where(near, 1.0, d)
        k1, k2 = (np.where(near, (a + b) / 2, (middle + r) / safe) for r in (-root, root))
        (p1, p2), (p3, p4) = ([normal_cdfs((k - m) / np.sqrt(v)) for m, v in ((a, v1), (b, v2))] for k in (k1, k2))
        area = np.where(near, np.abs(p1 - p2), np.abs(p3 - p1 + p2 - p4))
        area = np.where((a == b) | (np.isnan(a) & np.isnan(b)), 0.0, area)
        seen = (m1 > min_cv) | (m2 > min_cv) | np.isnan(m1) | np.isnan(m2)
        return np.where(seen, np.where(np.isnan(area), 1 - 1e-6, np.clip(area, 1e-6, 1 - 1e-6)), np.nan)


def _log_gamma(z: Column) -> Column:
    """Log of the gamma function for z >= 0.5: Stirling's series eight steps on."""
    w = z + 8
    steps = z
    for i in range(1, 8):
        steps = steps * (z + i)
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * F.pow(w, 5)) - F.log(steps)


def poisson_tail(a: Column, x: Column) -> Column:
    """The regularised lower gamma function of a and x: P(Poisson(x) >= a), for any real a > 0. Its series has terms as long as x is wide."""
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    grow = lambda acc, n: F.struct((acc["t"] * x / (a + n)).alias("t"), (acc["s"] + acc["t"] * x / (a + n)).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), (F.ceil(2 * x) + 60).cast("int")), start, grow, lambda acc: acc["s"])
    return F.exp(a * F.log(x) - x - _log_gamma(a + 1)) * total


def poisson_overlap(m1: Column, m2: Column) -> Column:
    """1 - shared mass of two Poisson distributions of different positive means, split where their densities cross; counts are taken as real numbers."""
    k = F.try_divide(m1 - m2, F.log(m1) - F.log(m2))
    return F.transform(F.array(k), lambda c: F.abs(poisson_tail(c + 1, m1) - poisson_tail(c + 1, m2)))[0]


def poisson_tails(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """poisson_tail of arrays. Rows leave the series when their terms are over."""
    total, order = np.ones(len(x)), np.argsort(-x, kind="stable")
    a, x, last = a[order], x[order], np.ceil(2 * x[order]) + 60
    t = np.ones(len(x))
    for n in range(1, int(last.max(initial=0)) + 1):
        k = int(np.searchsorted(-last, -n, side="right"))  # the first k rows have an n-th term
        t[:k] *= x[:k] / (a[:k] + n)
        total[:k] += t[:k]
    z, w = a + 1, a + 9
    steps = z.copy()
    for i in range(1, 8):
        steps *= z + i
    log_gamma = (w - 0.5) * np.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w**5) - np.log(steps)
    out = np.empty(len(x))
    out[order] = np.exp(a * np.log(x) - x - log_gamma) * total
    return out


def poisson_overlaps(m1: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """poisson_overlap of arrays; nan for equal means and where one is nan."""
    out, at = np.full(len(m1), np.nan), np.flatnonzero((m1 != m2) & ~np.isnan(m1) & ~np.isnan(m2))
    m1, m2 = m1[at], m2[at]
    c = (m1 - m2) / (np.log(m1) - np.log(m2))
    out[at] = np.abs(poisson_tails(c + 1, m1) - poisson_tails(c + 1, m2))
    return out


def erlang_cdf(n: Column, x: Column) -> Column:
    """P(chi-squared with 2n degrees <= 2x) = 1 - exp(-x) * sum of x^k / k! for k < n, summed by a running term.

    Beyond x = 500, where terms would overflow, by the cube-root normal approximation (Wilson and Hilferty).
    """
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, lambda a, k: F.struct((a["t"] * x / k).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])
    z = 3 * F.sqrt(n) * (F.pow(x / n, 1 / 3) - 1 + 1 / (9 * n))
    return F.when(x > 500, normal_cdf(z)).otherwise(1 - F.exp(-x) * total)


def composite_score(s_abd: Column, s_tnf: Column, s_cor: Column, nnz: Column, samples: int) -> Column:
    w = 1 / (1 + nnz)
    mixed = F.pow(s_abd, 1 - w) * F.pow(s_tnf, w)
    return s_tnf if samples < 1 else F.sqrt(mixed * s_cor) if samples >= 3 else mixed


def combined_distance(tnf: Column, abd: Column, nnz: Column) -> Column:
    """The older engine's distance of a pair."""
    w = F.least(F.log(nnz + 1) / F.log(F.lit(101.0)), F.lit(0.9))
    return F.when(nnz == 0, tnf).when(tnf > 0.05, F.greatest(tnf, 0.9 * abd)).otherwise(abd * w + tnf * (1 - w))


def correlation_cutoff(size: Column, min_corr: float) -> Column:
    """Linear in log10(size) from min_corr at 1000 to 99 at 100000 bases; a fraction of at most 0.99."""
    slope = (99 - min_corr) / 2
    return F.least(F.lit(0.99), (F.lit(min_corr) + slope * (F.log10(size.cast("double")) - 3)) / 100)


def with_ranks(df: DataFrame, value: str, keys: list[str], tie: list[str]) -> DataFrame:
    """Adds rank_min, rank_max, rank_avg and rank_first of a value inside each key."""
    w = Window.partitionBy(*keys).orderBy(value)
    return df.withColumns({
        "rank_min": F.rank().over(w).cast("long"),
        "rank_max": F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "rank_first": F.row_number().over(Window.partitionBy(*keys).orderBy(value, *tie)).cast("long"),
    }).withColumn("rank_avg", (F.col("rank_min") + F.col("rank_max")) / 2)


def partial_ranks(df: DataFrame, value: str, keys: list[str], tie: list[str], num: int, descending: bool = False) -> DataFrame:
    """Adds place (the order, from 1, of every row inside its key) and rank_min, rank_max, rank_avg of the first `num`; 0 beyond them.

    Ties are ranked among the first `num` rows only. With a large `num` these are whole ranks, ascending or descending.
    """
    up = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    rows = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(up(value), *tie)).cast("long"))
    inside = F.col("place") <= num
    w = Window.partitionBy(*keys, "_in").orderBy(up(value))
    low, high = F.rank().over(w).cast("long"), F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumn("_in", inside).withColumns({"rank_min": F.when(inside, low).otherwise(0), "rank_max": F.when(inside, high).otherwise(0)})
    return ranked.drop("_in").withColumn("rank_avg", (F.col("rank_min") + F.col("rank_max")) / 2)


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, rank_min, rank_max) over the whole table, without a global window over rows.

    Distinct values fall into ranges of a quantile sketch; a range's rows stand behind the sums of the ranges before it.
    """
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = _ranged(counts, parts)
    sums = placed.groupBy("range").agg(F.sum("n").alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sums.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(base), "range").withColumn("rank_max", F.col("base") + F.sum("n").over(inside))
    return out.select("value", "n", (F.col("rank_max") - F.col("n") + 1).alias("rank_min"), "rank_max")


def percentiles(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, at, q): of each key's values, nulls apart, the percentiles `at` of `shares`, linear between neighbours. Distinct values are counted and ranked in ranges, so that no task holds a key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    placed = _ranged(counts, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sums = placed.groupBy("key", "range").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("key").orderBy("range")  # a row for each range
    base = sums.select(F.col("key").alias("k"), F.col("range").alias("r"), F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("total").over(Window.partitionBy("key")).alias("all"))
    inside = Window.partitionBy("key", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(F.broadcast(base), F.col("key").eqNullSafe(F.col("k")) & (F.col("range") == F.col("r"))).drop("k", "r")
    ranked = ranked.withColumn("high", F.col("base") + F.sum("n").over(inside)).withColumn("at", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    place = F.col("at") * (F.col("all") - 1)
    here = lambda rank: F.max(F.when((F.col("high") - F.col("n") < rank + 1) & (rank + 1 <= F.col("high")), F.col("value")))
    ends = ranked.withColumn("place", place).groupBy("key", "at").agg(F.max("place").alias("place"), here(F.floor("place")).alias("lo"), here(F.ceil("place")).alias("hi"))
    part = F.col("place") - F.floor("place")
    return ends.select(F.col("key").alias(key), "at", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - part) * F.col("lo") + part * F.col("hi")).alias("q"))


def _ranged(counts: DataFrame, parts: int) -> DataFrame:
    bounds = sorted(set(counts.approxQuantile("value", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    limits = F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>")
    return counts.withColumn("range", F.size(F.filter(limits, lambda b: b < F.col("value"))))


#: Ranks that one group of a rank mapping stands for.
RANK_BLOCK = 1 << 16


def quantile_map(df: DataFrame, source: str, target: str, ranks: str = "rank_min") -> DataFrame:
    """Adds `mapped`: the target column's sorted value at the source value's rank."""
    to = value_ranks(df, target).select(F.col("value").alias("_to"), F.col("rank_min").alias("_lo"), F.col("rank_max").alias("_hi"))
    of = value_ranks(df, source).select(F.col("value").alias("_of"), F.col(ranks).alias("_rank"))
    # ranks are dense integers: each target value stands for the ranks lo..hi. In blocks of ranks the last value that begins at or before a rank is the one: sorted, not compared two by two
    first = F.floor(F.col("_lo") / RANK_BLOCK)
    begin = to.withColumn("_b", F.explode(F.sequence(first, F.floor(F.col("_hi") / RANK_BLOCK)))).select("_b", F.greatest("_lo", F.col("_b") * RANK_BLOCK).alias("_at"), F.struct("_to").alias("_s"), F.lit(None).cast(of.schema["_of"].dataType).alias("_of"))
    asked = of.where("_of IS NOT NULL").select(F.floor(F.col("_rank") / RANK_BLOCK).alias("_b"), F.col("_rank").alias("_at"), F.lit(None).cast(begin.schema["_s"].dataType).alias("_s"), "_of")
    so_far = Window.partitionBy("_b").orderBy("_at", F.col("_of").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = begin.unionByName(asked).withColumn("_s", F.last("_s", ignorenulls=True).over(so_far)).where("_of IS NOT NULL").select("_of", F.col("_s._to").alias("_to"))
    return df.join(met.select("_of", F.col("_to").alias("mapped")), F.col(source) == F.col("_of")).drop("_of")
