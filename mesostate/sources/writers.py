"""Writers of features, models, decoded tables, diagnostics and reports.

Tables go out as Parquet by Spark's writers.  What is one row or a few (summaries, logs, tables of states) may also go
out as one CSV or JSON file; those writers take a table of bounded size and say so.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.operators.models import Components, Hmm

#: Rows that a single-file writer takes.
MOST_ROWS = 100_000


def description_hash(description: dict) -> str:
    """A short name of a description: the same for equal ones, whatever their order."""
    return hashlib.sha256(json.dumps(description, sort_keys=True, default=str).encode()).hexdigest()[:16]


def features(df: DataFrame, folder: str, description: dict, by: str = "session", redo: bool = False) -> str:
    """Writes a feature table under a folder named by its description, and returns that; a finished one is left alone (SNK2).

    Sessions are partitions.  Spark's success marker says that a folder is finished, so a broken run is done anew, and
    another description never meets old features.
    """
    spark = df.sparkSession
    out = f"{folder}/{description_hash(description)}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
    if redo or not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        df.write.mode("overwrite").partitionBy(by).parquet(out)
    return out


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``file, n_bytes, md5`` of all files under a folder, read whole by the executors, in order of their names (SNK5)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"), F.md5("content").alias("md5")).orderBy("file")


def single_file(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A table of at most ``MOST_ROWS`` rows as one file of a folder; a larger one is refused."""
    n = df.limit(MOST_ROWS + 1).count()
    if n > MOST_ROWS:
        raise ValueError(f"a table of over {MOST_ROWS} rows does not go into one file; write it as Parquet")
    writer = df.coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def model(fitted: Hmm, folder: str, spark: SparkSession) -> None:
    """States, transitions and record of a model as tables (SNK6 to SNK8, SNK12)."""
    rows = [(k, float(fitted.start[k]), fitted.mean[k].tolist(), np.asarray(fitted.var if fitted.covariance == "tied" else fitted.var[k]).ravel().tolist()) for k in range(len(fitted.start))]
    spark.createDataFrame(rows, "state int, start double, mean array<double>, covariance array<double>").withColumn("kind", F.lit(fitted.covariance)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/states")
    fitted.transitions(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/transitions")
    single_file(fitted.record(spark), f"{folder}/train_log", "json")


def read_model(spark: SparkSession, folder: str) -> Hmm:
    """The model that ``model`` wrote."""
    states = sorted(spark.read.parquet(f"{folder}/states").collect(), key=lambda r: r["state"])
    k, d, kind = len(states), len(states[0]["mean"]), states[0]["kind"]
    step = np.zeros((k, k))
    for r in spark.read.parquet(f"{folder}/transitions").collect():
        step[r["i"], r["j"]] = r["p"]
    var = np.array([r["covariance"] for r in states])
    var = var if kind == "diag" else var.reshape(k, d, d) if kind == "full" else var[0].reshape(d, d)
    log = spark.read.json(f"{folder}/train_log").first()
    return Hmm(np.array([r["start"] for r in states]), step, np.array([r["mean"] for r in states]), var, tuple(log["log_likelihoods"]), log["converged"], kind)


def components(fitted: Components, folder: str, spark: SparkSession) -> None:
    """Loadings, means and explained shares as tables (SNK3, SNK4)."""
    rows = [(k, float(r), w.tolist()) for k, (r, w) in enumerate(zip(fitted.ratio, fitted.loadings, strict=True))]
    spark.createDataFrame(rows, "component int, ratio double, loadings array<double>").withColumn("mean", F.lit(fitted.mean.tolist()).cast("array<double>")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/components")
    fitted.curve(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/explained")


def experiment(folder: str, state_stats: DataFrame, fo: DataFrame, summary: DataFrame, path: DataFrame | None = None) -> None:
    """What decoding leaves of an experiment, under the same names for every kind of it (SNK9 to SNK13).

    Occupancies are rounded to six places.  The path, of any size, goes out as Parquet alone.
    """
    rounded = fo.withColumn("fo", F.round("fo", 6))
    for name, table in (("state_stats", state_stats), ("fo_by_session", rounded), ("summary", summary)):
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    if path is not None:
        path.write.mode("overwrite").parquet(f"{folder}/path")
    single_file(state_stats, f"{folder}/state_stats_csv")
    single_file(summary, f"{folder}/summary_json", "json")


def as_json(df: DataFrame, into: str = "json") -> DataFrame:
    """Each row as one JSON object, for diagnostics (SNK14), splits (SNK16) or manifests."""
    return df.select(F.to_json(F.struct("*")).alias(into))


def markdown(df: DataFrame, title: Column, sections: dict[str, list[str]], into: str = "report") -> DataFrame:
    """A Markdown report of each row: a title, and for each section a list of its columns (SNK15)."""

    def line(name: str) -> Column:
        kind = dict(df.dtypes)[name]
        value = F.when(F.col(name).isNotNull(), F.format_string("%.4f", F.col(name))) if kind in ("double", "float") else F.col(name).cast("string")
        return F.concat(F.lit(f"- **{name}**: "), F.coalesce(value, F.lit("-")))

    parts = [F.concat(F.lit("# "), title)]
    for section, names in sections.items():
        parts += [F.lit(f"\n## {section}\n"), *[line(n) for n in names]]
    return df.withColumn(into, F.concat_ws("\n", *parts))


#: Sections of a feature's report, in their order.
SECTIONS = ("Metadata", "Distribution", "Temporal Smoothness", "Stationarity", "Redundancy", "Inter-Subject Variability", "HMM Compatibility")


def feature_report(features: DataFrame, sections: dict[str, DataFrame], pairs: DataFrame | None = None, key: str = "feature", into: str = "report") -> DataFrame:
    """``key, report``: the whole report of each feature in Markdown (SNK15).

    ``sections`` has a table with a row a feature for each heading of ``SECTIONS`` that is to be shown; ``pairs`` (``key,
    other, r``) are listed under Redundancy, strongest first.  Numbers have four digits; what is null shows as a dash.
    """
    if unknown := set(sections) - set(SECTIONS):
        raise ValueError(f"unknown sections {sorted(unknown)}")
    parts: list[Column] = [F.lit("# Feature Diagnostic Report\n"), F.concat(F.lit("## "), F.col(key).cast("string"), F.lit("\n"))]
    found = features.select(key)
    for heading in SECTIONS:
        if heading not in sections and not (heading == "Redundancy" and pairs is not None):
            continue
        lines = []
        if heading in sections:
            table = sections[heading]
            names = [c for c in table.columns if c != key]
            text = lambda t, c: F.format_string("%.4f", F.col(c)) if t.schema[c].dataType.typeName() in ("double", "float") else F.array_join(c, ", ") if t.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
            own = table.select(key, F.concat_ws("\n", *[F.concat(F.lit(f"- **{c}**: "), F.coalesce(F.when(F.col(c).isNotNull(), text(table, c)), F.lit("-"))) for c in names]).alias(f"_{heading}"))
            found = found.join(own, key, "left")
            lines.append(F.col(f"_{heading}"))
        if heading == "Redundancy" and pairs is not None:
            line = F.concat(F.lit("  - "), F.col(key).cast("string"), F.lit(" ↔ "), F.col("other").cast("string"), F.format_string(" (corr=%.3f)", F.col("r")))
            listed = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.abs("r")).alias("a"), "other", line.alias("line")))).alias("w"))  # features at most
            found = found.join(listed.select(key, F.concat_ws("\n", F.lit("- **redundant_pairs**:"), F.array_join(F.col("w.line"), "\n")).alias("_pairs")), key, "left")
            lines.append(F.coalesce("_pairs", F.lit("- **redundant_pairs**: -")))
        parts.append(F.concat(F.lit(f"## {heading}\n\n"), F.concat_ws("\n", *lines), F.lit("\n")))
    return found.select(key, F.concat_ws("\n", *parts).alias(into))
