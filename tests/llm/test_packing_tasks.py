import random

from binsparrow.llm import packing


def test_rounds_of_few_pieces_are_few_tasks(spark, monkeypatch):
    """With many shuffle partitions that nothing coalesces, a round of few rows is a task for each core, and every item has its place."""
    rng = random.Random(4)
    sizes = [rng.randint(1, 100) for _ in range(400)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item_id long, size int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rounds, materialize = [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: rounds.append((name, df.rdd.getNumPartitions())) or materialize(df, name))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.best_fit(items, 100).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    cores = spark.sparkContext.defaultParallelism
    assert cores < 64 and rounds and all(n <= cores for name, n in rounds if name == "packing-round")
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, sizes[r.item_id]))
    assert len(got) == 400
    for rows in held.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(s for _, s in rows[:i]) for i in range(len(rows))] and sum(s for _, s in rows) <= 100
    assert len(held) <= 1.05 * sum(sizes) / 100 + 1
