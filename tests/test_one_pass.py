"""Steps that ask for the same edges several times make them once."""

from pyspark.sql import functions as F

from binsparrow.operators import clustering, ensemble


def _exchanges(df):
    return sum("Exchange" in x for x in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_pairs_edges_and_fallback_meet_in_one_shuffle(spark):
    """pairs, edges and fallback were shuffled for two joins, after a distinct over all pairs."""
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (3, 1), (4, 5), (5, 4), (5, 4), (6, 7)], "src long, dst long")
    edges = spark.createDataFrame([(1, 2, 0.7), (8, 9, 0.6)], "src long, dst long, w double")
    far = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.25), (4, 5, 0.5)], "src long, dst long, d double")
    found = ensemble.pair_probability(pairs, edges, far)
    assert _exchanges(found) == 1
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 2, 0.7), (2, 1, 0.7), (1, 1, 1.0), (3, 1, 0.75), (4, 5, 0.5), (5, 4, 0.5), (5, 4, 0.5), (6, 7, None)], key=str)


def test_mates_are_found_in_one_pass(spark):
    """the edges were made for each direction, for the third mates and for either side of the reciprocal join."""
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.1), (2, 3, 0.2), (2, 4, 0.85), (5, 6, 0.3), (5, 5, 0.9), (7, 8, 0.5), (7, 9, 0.5), (7, 10, 0.5)], "src long, dst long, w double")
    pairs = ensemble.both_ways(edges).select(F.col("src").alias("idx"), F.col("dst").alias("mate"), F.col("w").alias("coverage"))
    found = ensemble.reciprocal(ensemble.mates(pairs, 1.01))
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3), (2, 4), (5, 6)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_medoids_are_made_once(spark, monkeypatch):
    """what gives the medoids ran to count them and again to deal them."""
    taken = spark.sparkContext.accumulator(0)
    once = F.udf(lambda x: taken.add(1) or x, "long").asNondeterministic()
    medoids = spark.createDataFrame([(1, 1), (2, 2)], "label long, contig_id long").select("label", once("contig_id").alias("contig_id"))
    contigs = spark.createDataFrame([(i, 5000) for i in range(1, 5)], "contig_id long, size long")
    depth = spark.createDataFrame([(i, s, float(v)) for i, row in enumerate([(1, 2, 9), (9, 2, 1), (1, 2, 8), (8, 3, 1)], 1) for s, v in zip("ANR", row)], "contig_id long, sample_id string, mean double").withColumn("var", F.lit(1.0))
    got = clustering.recruit_by_medoid(contigs.where("contig_id > 2"), medoids, contigs, depth).collect()
    assert {r.contig_id: r.label for r in got} == {3: 1, 4: 2} and taken.value == 2
