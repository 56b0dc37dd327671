import random

import pytest
from pyspark.sql import functions as F

from binsparrow.sources import files, sinks


def wrapped(seq):
    return "".join(seq[k : k + 60] + "\n" for k in range(0, len(seq), 60))


def test_output_of_a_run(spark, tmp_path):
    """Names, order and wrapping of every file; one large bin is written by several tasks."""
    rng = random.Random(2)
    rows = [(i, f"c{i}", "".join(rng.choices("ACGT", k=rng.choice([0, 59, 60, 61, 500]))), "tooShort" if i % 11 == 0 else "large") for i in range(400)]
    rows[5] = (5, "ünï", "AC\nGT\r\n", "large")
    contigs = spark.createDataFrame(rows, "contig_id long, name string, seq string, size_class string").repartition(7)
    number = {i: 1 if i % 3 else 2 for i, *_ in rows if i % 11 and i % 5 and i != 7}
    number[5] = 2
    bins = spark.createDataFrame(list(number.items()), "contig_id long, bin_id int")
    low = spark.createDataFrame([(10,), (20,), (11,)], "contig_id long")
    parts = files.placed(files.output_lines(contigs, bins, low, "out", False, True, True, F.col("seq"))).select(F.spark_partition_id())
    assert parts.count() == 400 + 400
    sinks.write_output(contigs, bins, f"file://{tmp_path}/r", low_depth=low)
    text = lambda ids: "".join(f">{rows[i][1]}\n{wrapped(rows[i][2].replace(chr(10), '').replace(chr(13), ''))}" for i in ids)
    want = {f"out.{b}.fa": text([i for i in range(400) if number.get(i) == b]) for b in (1, 2)}
    want["out"] = "".join(f"{rows[i][1]}\t{number.get(i, 0)}\n" for i in range(400))
    want["out.tooShort.fa"] = text(range(0, 400, 11))
    want["out.lowDepth.fa"] = text([10, 20])
    want["out.unbinned.fa"] = text([i for i in range(400) if i % 11 and i not in number and i not in (10, 20)])
    assert {p.name: p.read_text() for p in (tmp_path / "r").iterdir()} == want
    sinks.write_output(contigs, bins, f"{tmp_path}/n", prefix="x", names_only=True, leftovers=False, membership=False)
    assert {p.name: p.read_text().split() for p in (tmp_path / "n").iterdir()} == {f"x.{b}": [rows[i][1] for i in range(400) if number.get(i) == b] for b in (1, 2)}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    good = spark.createDataFrame([("a", 1, "x\n"), ("b", 2, "y\n")], "file string, key long, text string")
    files.write_named(good, f"{tmp_path}/f")
    assert (tmp_path / "f/a").read_text() == "x\n"
    late = F.when(F.rand() < 2, F.raise_error(F.lit("lost"))).cast("string")
    placed = files.placed
    bad = lambda lines: placed(lines).withColumn("value", F.when(F.col("file") == "b", F.encode(late, "UTF-8")).otherwise(F.col("value")))
    files.placed = bad
    try:
        with pytest.raises(Exception, match="lost"):
            files.write_named(good.withColumn("text", F.lit("new\n")), f"{tmp_path}/f")
    finally:
        files.placed = placed
    assert {p.name: p.read_text() for p in (tmp_path / "f").iterdir()} == {"a": "x\n", "b": "y\n"}
    with pytest.raises(ValueError, match="mounted"):
        files.write_named(good, "s3://bucket/x")
