"""Depths of both ends of an edge: one row an edge, distances by arrays."""

import math

import numpy as np
from pyspark.sql import functions as F

from binsparrow.functions import statistics
from binsparrow.operators import depths


def _made(spark):
    rng = np.random.default_rng(3)
    rows = [(i, s, float(rng.uniform(0, 40)), float(rng.uniform(0, 90))) for i in range(12) for s in "ANR" if (i, s) not in ((2, "N"), (5, "A"), (5, "R"), (7, "A"))]
    depth = spark.createDataFrame([*rows, (90, "A", 3.0, 3.0)], "contig_id long, sample_id string, mean double, var double")
    return spark.createDataFrame([(i, j, 0.5) for i in range(12) for j in range(i + 1, 12)] + [(1, 99, 0.5)], "src long, dst long, w double"), depth


def test_arrays_are_the_columns(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, r)) for r in rng.uniform(0, 60, (300, 4))] + [(5.0, 2.0, 5.0, 9.0), (0.0, 0.0, 0.0, 0.0), (0.5, 3.0, 0.2, 3.0), (30.0, 4.0, 31.0, 4.0), (1e6, 1e3, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, va double, b double, vb double")
    got = df.select(statistics.depth_distance(F.col("a"), F.col("va"), F.col("b"), F.col("vb"), 1.0).alias("d"), statistics.poisson_overlap(F.col("a") + 1, F.col("b") + 2).alias("p")).where("a < 1000").collect()
    m = np.array(rows)[:-1]
    found, tails = statistics.depth_distances(*m.T), statistics.poisson_overlaps(m[:, 0] + 1, m[:, 2] + 2)
    for r, d, p in zip(got, found, tails, strict=True):
        assert math.isnan(d) if r.d is None else abs(r.d - d) < 1e-12
        assert math.isnan(p) if r.p is None else abs(r.p - p) < 1e-11


def test_samples_that_one_end_lacks(spark):
    edges, depth = _made(spark)
    a, b = (depth.select(F.col("contig_id").alias(e), "sample_id", F.col("mean").alias(f"m{i}"), F.col("var").alias(f"v{i}")) for i, e in ((1, "src"), (2, "dst")))
    plain = edges.join(a, "src").join(b, ["dst", "sample_id"])
    key = lambda df: sorted(map(tuple, df.select("src", "dst", "w", "sample_id", "m1", "v1", "m2", "v2").collect()))
    assert key(plain) == key(depths.with_depths(edges, depth))
    want = plain.withColumn("d", statistics.depth_distance(F.col("m1"), F.col("v1"), F.col("m2"), F.col("v2"), 20)).groupBy("src", "dst").agg(F.exp(F.avg(F.log("d"))).alias("g"), F.avg(1 - F.col("d")).alias("s"), F.count("d").alias("nnz")).where("nnz > 0")
    met = want.join(depths.geometric_distance(edges, depth, 20).withColumnRenamed("nnz", "n1"), ["src", "dst"], "full").join(depths.overlap(edges, depth, 20).select("src", "dst", "s_abd", F.col("nnz").alias("n2")), ["src", "dst"], "full").collect()
    assert len(met) == want.count() > 30
    assert all(abs(r.g - r.d_abd) < 1e-12 and abs(r.s - r.s_abd) < 1e-12 and r.nnz == r.n1 == r.n2 and r.w == 0.5 for r in met)


def test_edges_pass_as_one_row(spark):
    """F16 to F19: samples were rows in two shuffles; now edges meet their depths as arrays, and distances are worked out once."""
    edges, depth = _made(spark)
    for df, calls in ((depths.geometric_distance(edges, depth), 1), (depths.geometric_distance(edges, depth, 25, True), 2), (depths.overlap(edges, depth), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "sample_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
        assert plan.count("ArrowEvalPython") == calls
