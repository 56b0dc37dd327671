import math
import random

import pytest
from pyspark.sql import functions as F

from binsparrow.config import BinningConfig, preset
from binsparrow.functions import composition, statistics
from binsparrow.operators import depths, scoring
from binsparrow.sources import readers, sinks

# sizes, distance, logit, similarity, worked out by hand from the model's coefficients
VECTORS = [((2500, 2500), 0.0, 8.4768, 0.9998), ((2500, 2500), 0.1, 5.8239, 0.9971), ((2500, 2500), 0.2, 3.1710, 0.9597), ((2500, 2500), 0.4, -1.7648, 0.1462), ((5000, 20000), 0.05, 7.4143, 0.9994), ((5000, 20000), 0.2, 1.5219, 0.8208), ((50000, 50000), 0.1, 4.0814, 0.9834), ((50000, 50000), 0.2, -1.0177, 0.2655), ((500000, 500000), 0.1, 1.5247, 0.8212)]


def test_model_vectors(spark):
    rows = spark.createDataFrame([(a, b, d) for (a, b), d, _, _ in VECTORS], "a long, b long, d double")
    p = composition.pre_prob(F.col("d"), composition.log_size(F.col("a")), composition.log_size(F.col("b")))
    for got, (_, _, logit, s) in zip(rows.select(p.alias("p"), composition.logistic(p).alias("s")).collect(), VECTORS, strict=True):
        assert abs(got.p - logit) < 2e-4 and abs(got.s - s) < 2e-4


def test_older_engine_has_the_same_distance(spark):
    """Its distance is 1 / (1 + exp(p)) of the first stage above logit 0.9, else of the second, but 0.1 at least: 1 less the similarity."""
    rng = random.Random(4)
    rows = [(rng.randint(1500, 900_000), rng.randint(1500, 900_000), rng.uniform(0, 0.6)) for _ in range(300)]
    p = composition.pre_prob(F.col("d"), composition.log_size(F.col("a")), composition.log_size(F.col("b")))
    df = spark.createDataFrame(rows, "a long, b long, d double").select((1 - composition.logistic(p)).alias("got"))
    for r, (a, b, d) in zip(df.collect(), rows, strict=True):
        lo, hi = sorted(math.log10(min(x, 500_000)) for x in (a, b))
        one, two = (-(composition.polynomial(tb, x, lo, hi) + d * composition.polynomial(tc, y, lo, hi)) for tb, x, tc, y in composition.STAGES)
        if one > math.log(9):
            want = 1 / (1 + math.exp(one))
        else:
            want = 1 / (1 + math.exp(two)) if two <= math.log(9) else 0.1
        assert abs(r.got - want) < 1e-9


def test_normal_cdf_and_overlap(spark):
    xs = [-8.0, -5.5, -1.0, -0.1, 0.0, 0.3, 2.0, 6.5, 9.0]
    for got, x in zip(spark.createDataFrame([(x,) for x in xs], "x double").select(statistics.normal_cdf(F.col("x")).alias("p")).collect(), xs, strict=True):
        assert abs(got.p - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-12
    cases = [(10.0, 4.0, 14.0, 9.0), (5.0, 2.0, 5.0, 8.0), (10.0, 4.0, 12.0, 4.0)]
    df = spark.createDataFrame(cases, "a double, va double, b double, vb double")
    c = [F.col(x) for x in ("a", "va", "b", "vb")]
    for got, (a, va, b, vb) in zip(df.select(statistics.normal_overlap(*c).alias("d"), statistics.normal_overlap(c[2], c[3], c[0], c[1]).alias("r")).collect(), cases, strict=True):
        pdf = lambda x, m, v: math.exp(-((x - m) ** 2) / 2 / v) / math.sqrt(2 * math.pi * v)
        step = 0.001
        shared = sum(min(pdf(i * step, a, va), pdf(i * step, b, vb)) for i in range(-60000, 60000)) * step
        assert abs(got.d - (1 - shared)) < 1e-4 and abs(got.d - got.r) < 1e-12


def test_erlang(spark):
    want = {1: 0.9, 2: 0.943948, 5: 0.989348}
    for n, p in want.items():
        x = -n * math.log(1 - 0.9)
        assert abs(spark.range(1).select(statistics.erlang_cdf(F.lit(n), F.lit(x)).alias("p")).first().p - p) < 1e-6


def test_profiles_are_strand_and_line_symmetric(spark):
    rng = random.Random(5)
    seq = "".join(rng.choice("ACGT") for _ in range(500))
    other = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    lines = "\n".join(seq[i : i + 60] for i in range(0, 500, 60)).lower()
    rows = spark.createDataFrame([(1, seq), (2, other), (3, lines), (4, "NNNN"), (5, "ACGTNACGT")], "contig_id long, seq string").withColumn("seq", composition.clean_sequence(F.col("seq")))
    got = {r.contig_id: r.tnf for r in composition.profiles(rows).collect()}
    assert len(got[1]) == 136 and got[1] == got[2] == got[3] and set(got[4]) == {0.0}
    assert sum(v > 0 for v in got[5]) == 1 and abs(sum(v * v for v in got[1]) - 1) < 1e-12


def test_value_ranks_and_map(spark):
    rng = random.Random(3)
    xs = [rng.randint(0, 50) / 2 for _ in range(400)]
    df = spark.createDataFrame([(i, x, x * x + 1) for i, x in enumerate(xs)], "i long, x double, y double")
    for r in statistics.value_ranks(df, "x").collect():
        assert r.rank_min == 1 + sum(v < r.value for v in xs) and r.rank_max == sum(v <= r.value for v in xs)
    ys = sorted(x * x + 1 for x in xs)
    for r in statistics.quantile_map(df, "x", "y").collect():
        assert r.mapped == ys[sum(v < r.x for v in xs)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first\nACGT\nacgN\n>c2\tx\r\nAC\r\nGT\n>c3\n")
    rows = {r.name: r for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows["c1"].seq == "ACGTACGN" and rows["c2"].seq == "ACGT" and rows["c3"].size == 0
    (tmp_path / "a.fq").write_text("@r1 c\nACGT\n+\nIIII\n@r2\nAC\n+\nII\n")
    assert [(r.name, r.comment, r.seq, r.qual) for r in readers.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("name").collect()] == [("r1", "c", "ACGT", "IIII"), ("r2", "", "AC", "II")]
    (tmp_path / "d.tsv").write_text("contigName\tcontigLen\ttotalAvgDepth\ts1\ts1v\ts2\ts2v\nc1 x\t8\t3\t1.5\t2\t3\t4\n")
    assert sorted((r.name, r.sample_id, r.mean, r["var"]) for r in readers.read_depth(spark, str(tmp_path / "d.tsv")).collect()) == [("c1", 0, 1.5, 2.0), ("c1", 1, 3.0, 4.0)]
    contigs = spark.createDataFrame([(1, "c1", "A" * 61), (2, "c2", "C" * 60)], "contig_id long, name string, seq string")
    bins = spark.createDataFrame([(1, 1)], "contig_id long, bin_id long")
    sinks.write_bins(contigs, bins, str(tmp_path / "bins"))
    assert "".join(p.read_text() for p in (tmp_path / "bins/bin_id=1").glob("part*")) == ">c1\n" + "A" * 60 + "\nA\n"
    assert {(r.name, r.label) for r in sinks.membership_table(contigs, bins).collect()} == {("c1", 1), ("c2", 0)}
    sinks.save_cache(bins, str(tmp_path / "cache"), min_contig=2500, min_p=75)
    assert sinks.load_cache(spark, str(tmp_path / "cache"), min_contig=2500, at_most_min_p=80).count() == 1
    assert sinks.load_cache(spark, str(tmp_path / "cache"), min_contig=2500, at_most_min_p=70) is None


def test_poisson_overlap(spark):
    """Equals plain sums of Poisson probabilities where the crossing point is whole; the tail is continuous between."""
    plain = lambda a, x: 1 - sum(math.exp(-x + i * math.log(x) - math.lgamma(i + 1)) for i in range(a))
    cases = [(a, x) for a in (1, 2, 5, 30, 90) for x in (1e-6, 0.3, 4.0, 25.0, 110.0)]
    df = spark.createDataFrame([(i, float(a), x) for i, (a, x) in enumerate(cases)], "i long, a double, x double").withColumn("t", statistics.poisson_tail(F.col("a"), F.col("x")))
    for r in df.collect():
        assert r.t == pytest.approx(plain(cases[r.i][0], r.x), abs=1e-10)
    pairs = [(2.0, 3.5), (3.5, 2.0), (0.5, 60.0), (1e-6, 4.0), (20.0, 20.5)]
    out = {(r.a, r.b): r.d for r in spark.createDataFrame(pairs, "a double, b double").withColumn("d", statistics.poisson_overlap(F.col("a"), F.col("b"))).collect()}
    assert out[2.0, 3.5] == pytest.approx(out[3.5, 2.0]) and 0 < out[20.0, 20.5] < 0.06 < out[2.0, 3.5] < 0.6 < out[0.5, 60.0] <= 1


def test_pooled_depths(spark):
    """Samples of low depth count as one together, if their sum is deep enough."""
    depth = spark.createDataFrame([(c, s, float(m), 1.0) for c, row in {1: (9, 3, 4), 2: (7, 1, 1), 3: (9, 3, 4), 4: (0, 1, 1), 5: (1, 0, 1)}.items() for s, m in enumerate(row)], "contig_id long, sample_id int, mean double, var double")
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "src long, dst long")
    plain = {(r.src, r.dst): r for r in depths.geometric_distance(edges, depth, 5).collect()}
    pooled = {(r.src, r.dst): r for r in depths.geometric_distance(edges, depth, 5, True).collect()}
    assert set(plain) == set(pooled) == {(1, 2), (1, 3)} and pooled[1, 2].nnz == plain[1, 2].nnz + 1 == 2
    low = spark.range(1).select(statistics.poisson_overlap(F.lit(7.0), F.lit(2.0)).alias("d")).first().d
    assert pooled[1, 2].d_abd == pytest.approx(math.sqrt(plain[1, 2].d_abd * low))
    assert pooled[1, 3].d_abd == pytest.approx(math.sqrt(plain[1, 3].d_abd)) and pooled[1, 3].nnz == 2


def test_config():
    assert preset("superspecific").p1 == 95
    with pytest.raises(ValueError):
        BinningConfig(min_contig=1000)


def test_correlation_without_variance(spark):
    """Equal depths in all samples: no correlation, and no division by zero."""
    rows = {1: (5, 5, 5), 2: (1, 2, 4), 3: (2, 4, 8), 4: (8, 4, 2)}
    depth = spark.createDataFrame([(c, s, float(m), 1.0) for c, row in rows.items() for s, m in enumerate(row)], "contig_id long, sample_id int, mean double, var double")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    got = {(r.src, r.dst): r.cor for r in depths.correlation(edges, depth, 3).collect()}
    assert got[1, 2] is None and got[2, 3] == pytest.approx(1) and -1 < got[3, 4] < 0


def test_percentiles_hold_no_key(spark):
    """As percentile() has them, by counts of distinct values in ranges: no aggregation holds a key's values."""
    rows = [(k, float((i * i * 7919) % 1009) if i % 11 else None) for k, n in (("a", 400), ("b", 1 + 1), (None, 57)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    found = statistics.percentiles(df, "k", "v", shares)
    got = {(r.k, r["at"]): r.q for r in found.collect()}
    want = {(r.k, p): r.q[i] for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in shares])).alias("q")).collect() for i, p in enumerate(shares)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "percentile" not in found._jdf.queryExecution().toString()


def test_rescoring_without_variance(spark):
    """An edge whose end has equal depths in all samples keeps its place, as the least correlated."""
    rows = {1: (5, 5, 5), 2: (12, 20, 40), 3: (14, 26, 50), 4: (40, 30, 6)}
    depth = spark.createDataFrame([(c, s, float(m), 4.0) for c, row in rows.items() for s, m in enumerate(row)], "contig_id long, sample_id int, mean double, var double")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)], "src long, dst long, s_tnf double")
    got = {(r.src, r.dst): r.s for r in scoring.rescored(edges, depth, 3).collect()}
    assert set(got) == {(1, 2), (2, 3), (3, 4)} and all(0 <= s <= 1 for s in got.values())
