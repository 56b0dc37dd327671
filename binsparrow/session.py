"""What jobs ask of a session: a shared folder, tables that cut lineages, and runs that can be taken up again."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names; a temporary one only where a local session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = sc.getConf().get("spark.checkpoint.dir", None)
        if base is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="spark-"))


class Run:
    """A run of named steps, each a table in `folder`. A step that an earlier run with the same key has finished is read instead of made.

    Used as a context: tables that operators write meanwhile go to the folder as well. When the run ends well, the folder is removed, unless
    it is to be kept; when it fails or is killed, finished steps stay for the next run. The result must be written elsewhere before the end.
    metrics() has a row for each step: its rows and sums, observed while it was written, and seconds.
    """

    current: Run | None = None

    def __init__(self, spark: SparkSession, key: str, folder: str | None = None, keep: bool = False):
        ensure_checkpoint_dir(spark)
        self.spark, self.keep = spark, keep
        self.folder = f"{folder or spark.sparkContext.getConf().get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/run-{key}"
        self.seen: list[tuple] = []

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        files, at = self._path(path)
        return files.exists(at)

    def remove(self, path: str) -> None:
        files, at = self._path(path)
        files.delete(at, True)

    def __enter__(self) -> Run:
        Run.current = self
        return self

    def __exit__(self, kind, *_) -> None:
        Run.current = None
        self.remove(f"{self.folder}/tables")
        if kind is None and not self.keep:
            self.remove(self.folder)

    def step(self, name: str, make: Callable[[], DataFrame], **sums: str) -> DataFrame:
        """The table of a step; sums: columns to add up, by the name of the sum."""
        path, began = f"{self.folder}/step-{name}", time.time()
        if self.exists(f"{path}/_SUCCESS"):
            self.seen.append((name, True, None, {}, 0.0))
            return self.spark.read.parquet(path)
        watch = Observation()
        df = make()
        df.observe(watch, F.count(F.lit(1)).alias("rows"), *[F.sum(c).cast("double").alias(n) for n, c in sums.items()]).write.mode("overwrite").parquet(path)
        found = dict(watch.get)
        self.seen.append((name, False, found.pop("rows"), {k: float(v or 0) for k, v in found.items()}, time.time() - began))
        return self.spark.read.schema(df.schema).parquet(path)

    def metrics(self) -> DataFrame:
        return self.spark.createDataFrame(self.seen, "step string, reused boolean, rows long, sums map<string,double>, seconds double")


def step(name: str, make: Callable[[], DataFrame], **sums: str) -> DataFrame:
    """A step of the run at hand; outside of one just the table."""
    return Run.current.step(name, make, **sums) if Run.current else written(make())


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder: cuts the lineage, and with it the estimated size, which grows in loops of joins."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{Run.current.folder}/tables" if Run.current else df.sparkSession.sparkContext.getCheckpointDir()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
