import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.errors import PySparkException

from binsparrow.config import BinningConfig
from binsparrow.functions import composition
from binsparrow.operators import clustering, depths, ensemble
from binsparrow.plans import binning
from binsparrow.sources import readers


def spark_hash(*values):
    """xxhash64 of one long and then ints."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", values[0]), 42)
    for v in values[1:]:
        h = xxhash.xxh64_intdigest(struct.pack("<i", v), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_weighted_propagation(spark):
    """Equals the same rounds walked in Python; communities of strong edges come out whole."""
    rng = random.Random(3)
    edges = {}
    for _ in range(900):
        a, b = rng.sample(range(60), 2)
        edges[min(a, b), max(a, b)] = rng.choice([0.9, 0.8]) if a % 3 == b % 3 else rng.choice([0.1, 0.05])
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    label = {v: v for v in near}
    for turn in range(100):
        new, moved = dict(label), False
        for v, friends in near.items():
            sums = {}
            for u, w in friends.items():
                sums[label[u]] = sums.get(label[u], 0) + w
            sums = {x: round(w, 9) for x, w in sums.items()}
            most = max(sums.values())
            if sums.get(label[v], 0) < most:
                moved = True
                if spark_hash(v, turn, 42) % 2 == 0:
                    new[v] = min(x for x, w in sums.items() if w == most)
        if not moved:
            break
        label = new
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, s double")
    got = {r.contig_id: r.label for r in clustering.weighted_propagation(df).collect()}
    assert got == label and len(set(got.values())) <= 6
    assert clustering.weighted_propagation(df.where("s < 0")).count() == 0


def test_greedy_merge(spark):
    """Equals merging one pair at a time, smallest bin first, starting again after each merge."""
    rng = random.Random(5)
    bins = {k: set(rng.sample(range(40 * (k % 4), 40 * (k % 4) + 45), rng.randint(3, 14))) for k in range(24)}
    rows = [(c, k) for k, members in bins.items() for c in members]
    k = 0
    while k < len(bins):
        order = sorted(bins, key=lambda x: (len(bins[x]), x))
        mine = order[k]
        to = next((o for o in order[k + 1 :] if len(bins[o] & bins[mine]) / len(bins[mine]) >= 0.4), None)
        if to is None:
            k += 1
        else:
            bins[to] |= bins.pop(mine)
            k = 0
    got = {}
    for r in ensemble.greedy_merge(spark.createDataFrame(rows + rows[:3], "contig_id long, label long"), 0.4).collect():
        got.setdefault(r.label, set()).add(r.contig_id)
    assert got == bins and len(bins) < 24


def test_bootstrap_keeps_large_clusters(spark):
    edges = [(a, b, 0.95) for g in (0, 10, 20) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(30, 31, 0.95)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    sizes = spark.createDataFrame([(c, 100 if 10 <= c < 20 else 4000) for c in range(40)], "contig_id long, size long")
    boot = ensemble.bootstrap(df, sizes, 3, 0.9, 0.9)
    assert {(r.contig_id, r.b, r.label) for r in boot.collect()} == {(c, b, g) for g in (0, 20) for c in range(g, g + 4) for b in (1, 2, 3)}
    assert {(r.contig_id, r.runs) for r in ensemble.runs_binned(boot).collect()} == {(c, 3) for g in (0, 20) for c in range(g, g + 4)}


def test_escalation_dissolves_small_bins(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (10, 11, 0.9)], "src long, dst long, w double")
    contigs = spark.createDataFrame([(1, 30_000), (2, 30_000), (3, 30_000), (4, 100), (10, 5000), (11, 5000)], "contig_id long, size long")
    bins = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (10, 10), (11, 10)], "contig_id long, label long")
    got = {(r.contig_id, r.label) for r in ensemble.escalate(edges, bins, contigs, 0.8, 0.4, 80_000).collect()}
    assert got == {(c, 1) for c in (1, 2, 3, 4)}


def test_strict_checks(spark):
    good = spark.createDataFrame([(1, "a", 3.0, 1.0), (1, "b", 0.0, 0.0)], "contig_id long, sample_id string, mean double, var double")
    assert depths.strict(good).count() == 2
    bad = good.unionByName(spark.createDataFrame([(2, "a", -1.0, 1.0)], good.schema))
    with pytest.raises(PySparkException, match="invalid depth of contig 2"):
        depths.strict(bad).collect()
    names = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "contig_id long, name string")
    assert [tuple(r) for r in readers.duplicate_names(names).collect()] == [("x", 2)] and readers.require_unique(names.where("contig_id < 2")).count() == 2
    with pytest.raises(PySparkException, match="comes twice"):
        readers.require_unique(names).collect()
    pairs = spark.createDataFrame([(0, 1, 2.0), (2, 1, 1.0)], "idx long, mate long, coverage double")
    assert readers.paired_whole(pairs, 3).count() == 2
    with pytest.raises(PySparkException, match="last contig"):
        readers.paired_whole(pairs, 4).collect()


def test_tetramers_by_brute_force(spark):
    rng = random.Random(2)
    seqs = [(i, "".join(rng.choices("ACGTN" if i % 3 else "ACGT", k=rng.randint(0, 90)))) for i in range(60)] + [(100, None), (101, ""), (102, "ACG"), (103, "acgtacgt"), (104, "AAAAé" * 3)]
    want = {}
    swap = str.maketrans("ACGT", "TGCA")
    for i, s in seqs:
        for p in range(len(s or "") - 3):
            w = s[p : p + 4]
            if set(w) <= set("ACGT"):
                key = i, min(w, w[::-1].translate(swap))
                want[key] = want.get(key, 0) + 1
    df = spark.createDataFrame(seqs, "contig_id long, seq string").withColumnRenamed("cnt", "cnt")
    assert {(r.contig_id, r.kmer): r.cnt for r in composition.tetramers(df).collect()} == want
    rows = {r.contig_id: r.tnf for r in composition.profiles(df).collect()}
    assert len(rows) == len(seqs) and sum(rows[100]) == sum(rows[101]) == 0 and abs(sum(v * v for v in rows[0]) - 1) < 1e-12


def test_pairs_are_followed(spark):
    """Round after round the free mates of members join; of two labels that come at once the least."""
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(55)})
    bins = {0: 5, 17: 3, 40: 9}
    want = dict(bins)
    while True:
        new = {}
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if x in want and y not in want:
                    new[y] = min(want[x], new.get(y, 99))
        if not new:
            break
        want |= new
    got = ensemble.follow_pairs(spark.createDataFrame(list(bins.items()), "contig_id long, label long"), spark.createDataFrame(pairs, "idx long, mate long"))
    assert {r.contig_id: r.label for r in got.collect()} == want and len(want) > 10


def test_recruits_by_brute_force(spark):
    """Leftovers that correlate by rank with exactly one bin as its members do with each other; both engines with depths run in this session too."""
    rng = np.random.default_rng(6)
    shape = rng.random((3, 8))
    rows, bins = {}, {}
    for c in range(60):
        g = c % 3
        rows[c] = shape[g] * 50 + rng.random(8) * (8 if c < 45 else 1 + c % 5)
        if c < 45:
            bins[c] = g
    depth = spark.createDataFrame([(c, s, float(v), 1.0) for c, r in rows.items() for s, v in enumerate(r)], "contig_id long, sample_id int, mean double, var double")
    z = {c: (q := r.argsort().argsort() - 3.5) / np.linalg.norm(q) for c, r in rows.items()}
    want = {}
    for c in range(45, 60):
        fits = []
        for g in range(3):
            m = [x for x in bins if bins[x] == g]
            own = np.mean([z[a] @ z[b] for a in m for b in m if a < b])
            if np.mean([z[c] @ z[x] for x in m[:10]]) >= own - 1e-9 and np.mean([z[c] @ z[x] for x in m]) >= own - 1e-9:
                fits.append(g)
        if len(fits) == 1:
            want[c] = fits[0]
    contigs = spark.createDataFrame([(c, 1000) for c in rows], "contig_id long, size long")
    members = spark.createDataFrame(list(bins.items()), "contig_id long, label long")
    got = clustering.recruit(contigs.where("contig_id >= 45"), members, contigs, depth, 0.9)
    assert {r.contig_id: r.label for r in got.collect()} == want != {}
    assert clustering.recruit(contigs.where("contig_id >= 45"), members, contigs, depth, 0.01).count() == 0


def test_steps_inside_runs(spark):
    """All runs at once give what each gives alone."""
    rng = random.Random(12)
    edges = spark.createDataFrame([(a, b, rng.choice([0.78, 0.82, 0.9, 0.97])) for a, b in sorted({tuple(sorted(rng.sample(range(50), 2))) for _ in range(110)})], "src long, dst long, w double")
    rows = spark.createDataFrame([(c, rng.choice([3000, 9000, 40_000]), "large") for c in range(50)], "contig_id long, size long, size_class string")
    pairs = spark.createDataFrame([(a, b, 9.0) for x, y in sorted({tuple(sorted(rng.sample(range(50), 2))) for _ in range(12)}) for a, b in ((x, y), (y, x))], "idx long, mate long, coverage double")
    boot = [(c, b, c % 5 + 10 * b) for b in (1, 2) for c in rng.sample(range(50), 25)]
    config = BinningConfig(bootstraps=2, min_cls_size=60_000)
    got = {(r.contig_id, r.b, r.label) for r in binning.finished_runs(edges, spark.createDataFrame(boot, "contig_id long, b int, label long"), rows, pairs, config).collect()}
    want = set()
    for b in (1, 2):
        bins = spark.createDataFrame([(c, x) for c, k, x in boot if k == b], "contig_id long, label long")
        bins = ensemble.join_adjacent(edges, ensemble.escalate(edges, bins, rows, 0.8, 0.4, 60_000), 0.95)
        bins = ensemble.greedy_merge(ensemble.follow_pairs(bins, ensemble.reciprocal(ensemble.mates(pairs))), 0.5)
        want |= {(r.contig_id, b, r.label) for r in bins.collect()}
    assert got == want and len(got) > 30


def test_weighted_propagation_in_tasks(spark, monkeypatch):
    """every round of a large graph was several joins of it. Components walked by tasks have the labels of the joins, as have components too large for a task."""
    rng = random.Random(9)
    edges = {}
    for g, n in enumerate((900, 300, 40, 30)):
        for _ in range(n):
            a, b = sorted(rng.sample(range(n // 8), 2))
            edges[1000 * g + a, 1000 * g + b] = round(rng.choice([0.1, 0.2, 0.3, 0.5]), 1)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, s double")
    got = lambda: {r.contig_id: r.label for r in clustering.weighted_propagation(df).collect()}
    want = got()
    joins, sizes = clustering._propagated, []
    monkeypatch.setattr(clustering, "_propagated", lambda e, *rest: sizes.append(e.count()) or joins(e, *rest))
    monkeypatch.setattr(clustering, "WALKED_FROM", 0)
    assert got() == want and len(set(want.values())) >= 4 and not sizes
    monkeypatch.setattr(clustering, "LOCAL_EDGES", 500)
    assert got() == want and len(sizes) == 1 and 500 < sizes[0] < len(edges) - 200
    one = df.where("false")
    assert clustering.weighted_propagation(one).count() == 0
