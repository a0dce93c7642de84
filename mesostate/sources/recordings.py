"""Recordings in plain text: a line a time step, a column a channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: the lines of all files under ``path`` with their numbers from 0, however files are split (SRC2).

    A line's place in its split and the lines of the splits before it, one number each, give its number; no task holds
    more than a split.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("_id"), "value")
    here = F.row_number().over(Window.partitionBy("file", "block").orderBy("_id")) - 1
    counts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block")) - F.col("_n")  # a row a split
    placed = raw.withColumn("_here", here).join(counts.select("file", "block", before.alias("_before")), ["file", "block"])
    return placed.select("file", (F.col("_here") + F.col("_before")).alias("line"), "value")


#: Lines that are counted together.
STRETCH = 65_536


def numbered_steps(lines: DataFrame) -> DataFrame:
    """``lines`` with ``step``, their place among those of their file that are left, by stretches of lines."""
    cut = lines.withColumn("_s", F.expr(f"line div {STRETCH}"))
    counts = cut.groupBy("file", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_s")) - F.col("_n")  # a row a stretch
    here = F.row_number().over(Window.partitionBy("file", "_s").orderBy("line")) - 1
    return cut.withColumn("_here", here).join(counts.select("file", "_s", before.alias("_before")), ["file", "_s"]).withColumn("step", F.col("_here") + F.col("_before")).drop("_s", "_here", "_before")


def text_epochs(spark: SparkSession, path: str, channels: list[str], size: int, separator: str = r"[\s,;]+", comment: str = "#") -> DataFrame:
    """``file, trial, channel, samples``: recordings cut into epochs of ``size`` time steps (SRC2).

    Blank lines and lines that start with ``comment`` are no time steps.  A last epoch that is not whole is left out.  A line
    without a number for each channel raises an error; further columns are not read.
    """
    lines = numbered_lines(spark, path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit(comment)))
    given = F.transform(F.slice(F.split(F.trim("value"), separator), 1, len(channels)), lambda v: v.try_cast("double"))
    whole = (F.size(given) == len(channels)) & ~F.exists(given, lambda v: v.isNull())
    numbers = F.when(whole, given).otherwise(F.raise_error(F.concat(F.lit("no number for each channel in line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))))
    cells = numbered_steps(lines).select("file", F.expr(f"step div {size}").alias("trial"), "step", F.posexplode(numbers).alias("at", "x"))
    found = cells.groupBy("file", "trial", "at").agg(F.array_sort(F.collect_list(F.struct("step", "x"))).alias("w")).where(F.size("w") == size)
    return found.select("file", "trial", F.element_at(F.lit(list(channels)), F.col("at") + 1).alias("channel"), F.col("w.x").alias("samples"))
