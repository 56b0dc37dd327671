"""Sinks: bins as FASTA or names, membership tables, leftovers, caches checked on reading."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import output_lines, write_named


def wrap(seq: Column, width: int = 60) -> Column:
    """Sequence in lines of `width`, each ended."""
    return F.when(seq == "", seq).otherwise(F.concat(F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", ""), F.lit("\n")))


def fasta_records(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace(wrap(F.col("seq")), "\n$", "")).alias("value"))


def write_bins(contigs: DataFrame, bins: DataFrame, path: str, names_only: bool = False) -> None:
    """A folder bin_id=<n> for each bin, members in order of contig_id. contigs(contig_id, name, seq), bins(contig_id, bin_id)."""
    rows = contigs.join(bins, "contig_id")
    value = F.col("name") if names_only else F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace(wrap(F.col("seq")), "\n$", ""))
    rows.repartition("bin_id").sortWithinPartitions("bin_id", "contig_id").select("bin_id", value.alias("value")).write.partitionBy("bin_id").text(path)


def write_output(contigs: DataFrame, bins: DataFrame, path: str, prefix: str = "out", low_depth: DataFrame | None = None, names_only: bool = False, leftovers: bool = True, membership: bool = True) -> None:
    """A run's files in one folder: <prefix>.<n>.fa for each bin, <prefix>.unbinned.fa, .tooShort.fa and .lowDepth.fa, and <prefix>, name and bin (0 for none) of every contig.

    contigs(contig_id, name, seq, size_class), bins(contig_id, bin_id). Contigs are in order of contig_id, sequences in lines of 60. With names_only
    files hold names and have no ending. A file is written by as many tasks as its size asks for, and all get their names at the end; files without contigs are not made.
    """
    record = F.concat(F.lit(">"), "name", F.lit("\n"), wrap(F.regexp_replace("seq", r"[\r\n]", "")))
    write_named(output_lines(contigs, bins.select("contig_id", "bin_id"), low_depth, prefix, names_only, leftovers, membership, record), path)


def membership_table(contigs: DataFrame, bins: DataFrame) -> DataFrame:
    """name, label; 0 for contigs in no bin."""
    return contigs.join(bins, "contig_id", "left").select("name", F.coalesce("bin_id", F.lit(0)).alias("label"))


def write_membership(contigs: DataFrame, bins: DataFrame, path: str) -> None:
    membership_table(contigs, bins).write.option("sep", "\t").csv(path)


def write_leftovers(contigs: DataFrame, bins: DataFrame, low_depth: DataFrame, path: str) -> None:
    """Unbinned, tooShort and lowDepth contigs as FASTA in folders of these names."""
    parts = {
        "unbinned": contigs.where("size_class <> 'tooShort'").join(bins, "contig_id", "left_anti").join(low_depth, "contig_id", "left_anti"),
        "tooShort": contigs.where("size_class = 'tooShort'"),
        "lowDepth": contigs.join(low_depth, "contig_id", "left_semi"),
    }
    for name, part in parts.items():
        fasta_records(part).write.text(f"{path}/{name}")


def save_cache(df: DataFrame, path: str, **made_with: object) -> None:
    """A table and what it was made with, in one place."""
    df.write.parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(json.dumps(made_with, sort_keys=True),)], "made_with string").coalesce(1).write.json(f"{path}/meta")


def load_cache(spark: SparkSession, path: str, **needed: object) -> DataFrame | None:
    """The cached table, or None if it was made with other values. A number given as at_most_<name> is an upper bound."""
    made = json.loads(spark.read.json(f"{path}/meta").first()["made_with"])
    for key, value in needed.items():
        name = key.removeprefix("at_most_")
        if name not in made or (made[name] > value if key != name else made[name] != value):
            return None
    return spark.read.parquet(f"{path}/data")
