"""The library's scalar functions for SQL text: each is a SQL body, so queries stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments, result and body of each function.
FUNCTIONS = (
    ("meso_variance", "x ARRAY<DOUBLE>", "DOUBLE", "aggregate(x, 0D, (s, v) -> s + pow(v - aggregate(x, 0D, (a, b) -> a + b) / size(x), 2)) / size(x)"),
    ("meso_steps", "x ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(slice(x, 2, size(x) - 1), (v, i) -> v - get(x, i))"),
    ("meso_mobility", "x ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN meso_variance(x) < 1e-12D THEN 0D ELSE sqrt(meso_variance(meso_steps(x)) / meso_variance(x)) END"),
    ("meso_entropy", "p ARRAY<DOUBLE>", "DOUBLE", "aggregate(p, 0D, (s, v) -> s - v * ln(v + 1e-12D))"),
    ("meso_band_share", "part DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE", "DOUBLE", "part / (a + b + c + 1e-10D)"),
    ("meso_asymmetry", "l DOUBLE, r DOUBLE", "DOUBLE", "(r - l) / (r + l + 1e-10D)"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to this session's SQL and returns their names."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
