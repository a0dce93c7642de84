"""Readers of labels, descriptions, manifests and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an experiment's folder must hold to be read (SRC12).
ARTEFACTS = ("state_stats", "fo_by_session", "summary")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """``base_id, condition, grp`` of a label table in CSV; a base id is the file's name in capitals before ``_sin_contexto`` (SRC7)."""
    raw = spark.read.csv(path, header=True, schema="npy_file string, subject_id string, condition string, grp string")
    return raw.select(F.upper(F.split("npy_file", "_sin_contexto")[0]).alias("base_id"), "condition", "grp")


def labelled(sessions: DataFrame, known: DataFrame, session: str = "session") -> DataFrame:
    """``sessions`` with condition and group of the base id that their name has, ``UNKNOWN`` without one."""
    base = F.upper(F.split(F.col(session).cast("string"), "_sin_contexto")[0])
    found = sessions.withColumn("base_id", base).join(known, "base_id", "left")
    return found.withColumns({c: F.coalesce(c, F.lit("UNKNOWN")) for c in ("condition", "grp")})


def description(path: str) -> dict:
    """An experiment's description in YAML (SRC8); numbers written as ``500e-6`` are numbers."""
    import yaml

    def number(value):
        if isinstance(value, dict):
            return {k: number(v) for k, v in value.items()}
        if isinstance(value, list):
            return [number(v) for v in value]
        try:
            return float(value) if isinstance(value, str) and "e" in value.lower() else value
        except ValueError:
            return value

    with open(path, encoding="utf-8") as text:
        return number(yaml.safe_load(text)) or {}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest or summary in JSON, one object over several lines (SRC10)."""
    return spark.read.json(path, multiLine=True)


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table in CSV with a header (SRC11)."""
    return spark.read.csv(path, header=True, schema=schema)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def experiments(spark: SparkSession, folders: dict[str, str]) -> tuple[dict[str, DataFrame], list[str]]:
    """Tables of all experiments that have every artefact, tagged with ``experiment``, and the names of those left out (SRC12)."""
    whole = {name: path for name, path in folders.items() if all(_exists(spark, f"{path}/{a}") for a in ARTEFACTS)}
    out: dict[str, DataFrame] = {}
    for name, path in sorted(whole.items()):
        for artefact in ARTEFACTS:
            table = spark.read.parquet(f"{path}/{artefact}").withColumn("experiment", F.lit(name))
            out[artefact] = out[artefact].unionByName(table, allowMissingColumns=True) if artefact in out else table
    return out, sorted(set(folders) - set(whole))
