"""What tasks hold and what goes through the driver does not grow with the tables."""

from binsparrow.operators import ensemble
from binsparrow.plans import registry


def test_partitions_follow_line_items(spark, monkeypatch):
    """F22 to F24, F28, F29: meeting line items were dealt to as many tasks as the session has partitions, whatever the table's size."""
    monkeypatch.setattr(registry, "ITEMS", 500)
    plan = registry.neighbours(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" in plan and plan.count(", 12), REPARTITION_BY_NUM") == 3


def test_followed_pairs_are_not_broadcast(spark, monkeypatch):
    """each round broadcast the membership while that was small."""
    plans, write = [], ensemble.written
    monkeypatch.setattr(ensemble, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "idx long, mate long")
    got = ensemble.follow_pairs(spark.createDataFrame([(1, 5), (4, 3)], "contig_id long, label long"), pairs)
    assert {tuple(r) for r in got.collect()} == {(1, 5), (2, 5), (3, 3), (4, 3)}
    assert not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
