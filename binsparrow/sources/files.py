"""Named text files of which each is written by many tasks.

Lines are sorted by (file, key), and each gets its place in its file: what stands before it in its range, plus the sizes of the ranges before. Tasks
write lines at their places into hidden files; when all have ended, the driver gives these their names. A failed or killed job leaves no file under its
name; a line that is written twice, by a repeated task, is the same bytes at the same place. The folder must be mounted where tasks and driver run.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import written

#: Bytes that a task holds before it writes them.
HELD = 8 << 20


class PlacedFiles(DataSource):
    """Sink of rows (file, at, value): bytes at their places."""

    @classmethod
    def name(cls) -> str:
        return "placed_files"

    def writer(self, schema, overwrite: bool) -> PlacedWriter:
        return PlacedWriter(self.options["path"], self.options["attempt"], overwrite)


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, attempt: str, overwrite: bool):
        self.path, self.hidden, self.overwrite = path, f"{path}/.{attempt}", overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.hidden, exist_ok=True)
        file, handle, begin, held, size = None, None, 0, [], 0

        def flush() -> None:
            data, at = b"".join(held), begin
            while data:
                n = os.pwrite(handle, data, at)
                data, at = data[n:], at + n

        try:
            for b in iterator:
                for name, at, value in zip(*(b.column(c).to_pylist() for c in ("file", "at", "value")), strict=True):
                    if name != file or at != begin + size or size > HELD:
                        if handle is not None:
                            flush()
                        if name != file:
                            if handle is not None:
                                os.close(handle)
                            handle, file = os.open(f"{self.hidden}/{name}", os.O_WRONLY | os.O_CREAT, 0o644), name
                        begin, held, size = at, [], 0
                    held.append(value)
                    size += len(value)
            if handle is not None:
                flush()
        finally:
            if handle is not None:
                os.close(handle)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.isdir(self.hidden):
            for name in sorted(os.listdir(self.hidden)):
                os.replace(f"{self.hidden}/{name}", f"{self.path}/{name}")
            os.rmdir(self.hidden)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file: the bytes of the same file before each in this partition."""
    file, at = None, 0
    for b in batches:
        places = []
        for name, size in zip(b.column("file").to_pylist(), b.column("size").to_pylist(), strict=True):
            file, at = name, at if name == file else 0
            places.append(at)
            at += size
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], [*b.schema.names, "inner"])


def placed(lines: DataFrame) -> DataFrame:
    """(file, at, value) of lines(file, key, text): every line's bytes and their place in its file, lines in order of key."""
    rows = lines.select("file", "key", F.encode(F.col("text"), "UTF-8").alias("value")).withColumn("size", F.octet_length("value").cast("long"))
    rows = rows.repartitionByRange("file", "key").sortWithinPartitions("file", "key")
    rows = rows.mapInArrow(_within, "file string, key long, value binary, size long, inner long").withColumn("part", F.spark_partition_id()).transform(written)
    sums = rows.groupBy("file", "part").agg(F.sum("size").alias("n"))  # a row for each partition and file in it
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, ["file", "part"]).select("file", (F.col("base") + F.col("inner")).alias("at"), "value")


def write_named(lines: DataFrame, path: str) -> None:
    """Files of a folder from lines(file, key, text): each file's texts in order of key, with nothing between."""
    if ":" in path.split("/")[0] and not path.startswith("file:"):
        raise ValueError("the folder must be mounted: files are written at places")
    folder = path.removeprefix("file://").removeprefix("file:")
    Path(folder).mkdir(parents=True, exist_ok=True)
    spark, attempt = lines.sparkSession, f"unfinished-{uuid.uuid4().hex}"
    spark.dataSource.register(PlacedFiles)
    try:
        placed(lines).sortWithinPartitions("file", "at").write.format("placed_files").option("attempt", attempt).mode("append").save(folder)
    finally:
        shutil.rmtree(f"{folder}/.{attempt}", ignore_errors=True)


def output_lines(contigs: DataFrame, bins: DataFrame, low_depth: DataFrame | None, prefix: str, names_only: bool, leftovers: bool, membership: bool, record: Column) -> DataFrame:
    """lines(file, key, text) of a run's output: `record` is a contig's text."""
    text = F.concat("name", F.lit("\n")) if names_only else record
    end = "" if names_only else ".fa"
    named = lambda df, file: df.select(file.alias("file"), F.col("contig_id").alias("key"), text.alias("text"))
    out = named(contigs.join(bins, "contig_id"), F.concat(F.lit(f"{prefix}."), F.col("bin_id").cast("string"), F.lit(end)))
    if membership:
        rows = contigs.join(bins, "contig_id", "left")
        out = out.unionByName(rows.select(F.lit(prefix).alias("file"), F.col("contig_id").alias("key"), F.concat("name", F.lit("\t"), F.coalesce("bin_id", F.lit(0)).cast("string"), F.lit("\n")).alias("text")))
    if leftovers:
        low = contigs.select("contig_id").where("false") if low_depth is None else low_depth.select("contig_id")
        short = F.col("size_class") == "tooShort"
        free = contigs.where(~short).join(bins, "contig_id", "left_anti").join(low, "contig_id", "left_anti")
        for kind, part in (("unbinned", free), ("tooShort", contigs.where(short)), ("lowDepth", contigs.where(~short).join(low, "contig_id", "left_semi"))):
            out = out.unionByName(named(part, F.lit(f"{prefix}.{kind}{end}")))
    return out
