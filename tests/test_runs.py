import random
from pathlib import Path

import pytest

from binsparrow.config import BinningConfig
from binsparrow.operators import admission
from binsparrow.plans import binning
from binsparrow.session import Run


def genomes(spark):
    rng = random.Random(7)
    rows = []
    for g in range(2):
        weights = [rng.random() for _ in range(4)]
        rows += [(6 * g + k, f"c{6 * g + k}", "".join(rng.choices("ACGT", weights, k=4000)), 4000) for k in range(6)]
    return spark.createDataFrame(rows, "contig_id long, name string, seq string, size long")


def left(spark, config, *inputs):
    run = Run(spark, config.key("bin_contigs", *inputs))
    return run.exists(run.folder)


def test_a_run_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    contigs, config = genomes(spark), BinningConfig(min_cls_size=10_000, seed=random.SystemRandom().randrange(1 << 30))
    whole = binning.run(spark, f"{tmp_path}/a", binning.bin_contigs, contigs, config=config, inputs=("x",)).collect()
    want = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/a").collect())
    assert [r.step for r in whole] == ["profiles", "graph", "edges", "bins"] and not any(r.reused for r in whole) and not left(spark, config, "x")
    assert whole[0].rows == 12 and whole[0].sums == {"bases": 48_000.0} and whole[1].rows == whole[2].rows > 0 and len(want) >= 6
    cluster = admission.cluster
    monkeypatch.setattr(admission, "cluster", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        binning.run(spark, f"{tmp_path}/b", binning.bin_contigs, contigs, config=config, inputs=("x",))
    monkeypatch.setattr(admission, "cluster", cluster)
    assert left(spark, config, "x") and Run.current is None
    again = binning.run(spark, f"{tmp_path}/b", binning.bin_contigs, contigs, config=config, inputs=("x",)).collect()
    assert [r.reused for r in again] == [True, True, True, False] and not left(spark, config, "x")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/b").collect()) == want
    binning.run(spark, f"{tmp_path}/c", binning.bin_contigs, contigs, config=config, inputs=("y",), keep=True)
    kept = Run(spark, config.key("bin_contigs", "y"))
    assert kept.exists(f"{kept.folder}/step-bins/_SUCCESS") and not kept.exists(f"{kept.folder}/tables")
    assert spark.read.parquet(f"{kept.folder}/cluster-log").columns == ["turn", "contig_id", "label"]
    kept.remove(kept.folder)


def test_keys():
    assert BinningConfig().key("a") == BinningConfig().key("a") != BinningConfig(seed=1).key("a") and BinningConfig().key("a") != BinningConfig().key("b")
