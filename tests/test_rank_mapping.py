"""Rank mapping by sorted blocks; correlation of an edge's arrays."""

import bisect
import random

import numpy as np

from binsparrow.functions import statistics
from binsparrow.operators import depths


def test_ranks_are_matched_by_order_not_two_by_two(spark, monkeypatch):
    """F8: of each block of 1024 ranks every value met every target; now a block is sorted once. Ties reach over blocks."""
    monkeypatch.setattr(statistics, "RANK_BLOCK", 4, raising=False)
    rng = random.Random(2)
    rows = [(i, float(rng.choice([0, 0, 0, 1, 5, rng.random()])), float(rng.choice([7, 7, rng.random() * 9, -1]))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    xs, ys = sorted(r[1] for r in rows), sorted(r[2] for r in rows)
    for ranks, side in (("rank_min", bisect.bisect_left), ("rank_max", lambda v, x: bisect.bisect_right(v, x) - 1)):
        found = statistics.quantile_map(df, "x", "y", ranks)
        assert {r.id: r.mapped for r in found.collect()} == {i: ys[side(xs, x)] for i, x, _ in rows}
        assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "_lo" in x]


def test_correlation_needs_no_row_for_each_sample(spark):
    """F8: three rows an edge went through a shuffle by edge."""
    rng = np.random.default_rng(4)
    rows = [(i, s, float(rng.uniform(0, 40)), 1.0) for i in range(6) for s in "ANR"] + [(9, s, 0.1, 1.0) for s in "ANR"] + [(8, "A", 2.0, 1.0), (8, "N", None, 1.0), (8, "R", 3.0, 1.0), (7, "Z", 1.0, 1.0)]
    depth = spark.createDataFrame(rows, "contig_id long, sample_id string, mean double, var double")
    edges = spark.createDataFrame([(i, j) for i in range(6) for j in range(i + 1, 6)] + [(0, 9), (1, 8), (2, 7)], "src long, dst long")
    found = depths.correlation(edges, depth)
    got = {(r.src, r.dst): r.cor for r in found.collect()}
    m = {(c, s): x for c, s, x, _ in rows}
    assert got.pop((0, 9)) is None and (2, 7) not in got
    assert abs(got.pop((1, 8)) - (1.0 if m[1, "R"] > m[1, "A"] else -1.0)) < 1e-9
    assert len(got) == 15 and all(abs(c - np.corrcoef(*[[m[v, s] for s in "ANR"] for v in e])[0, 1]) < 1e-9 for e, c in got.items())
    assert "inline" not in found._jdf.queryExecution().optimizedPlan().toString()
