"""Windows, embeddings and features of epoched signals, as array expressions.

An epoch is a row with ``samples array<double>``; no operator here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def sliding_windows(epochs: DataFrame, size: int, step: int, trim: int = 0) -> DataFrame:
    """A row for each whole window; short epochs and trims that leave nothing raise (WIN1 to WIN4)."""
    n = F.floor((F.size("samples") - size) / step).cast("int") + 1
    checked = F.when((F.size("samples") < size) | (n <= 2 * trim), F.raise_error("epoch too short for its windows")).otherwise(F.sequence(F.lit(trim), n - 1 - trim))
    cut = F.transform(checked, lambda i: F.slice("samples", i * step + 1, F.lit(size)))
    return epochs.select(*[c for c in epochs.columns if c != "samples"], F.posexplode(cut).alias("win_idx", "samples"))


def embed(epochs: DataFrame, n_lags: int, lag_step: int = 1) -> DataFrame:
    """Time-delay embedding: for each valid t, the samples at t, t - step, ... (TDE1, TDE2)."""
    reach = n_lags * lag_step
    times = F.when(F.size("samples") <= reach, F.raise_error("epoch too short to embed")).otherwise(F.sequence(F.lit(reach), F.size("samples") - 1))
    rows = F.transform(times, lambda t: F.struct(t.alias("t"), F.array(*[F.get("samples", t - k * lag_step) for k in range(n_lags + 1)]).alias("x")))
    return epochs.select(*[c for c in epochs.columns if c != "samples"], F.inline(rows))


def embed_channels(epochs: DataFrame, trial: list[str], channel: str, n_lags: int, lag_step: int = 1) -> DataFrame:
    """``trial, t, x``: for each valid t of a trial, all its channels in order of their names, lag after lag (TDE3).

    A trial is one group of as many rows as it has channels; they must be of one length.
    """
    wide = epochs.groupBy(*trial).agg(F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), F.col("samples").alias("s")))).alias("m"))
    n, reach = F.size(F.col("m")[0]["s"]), n_lags * lag_step
    uneven = F.exists("m", lambda c: F.size(c["s"]) != n)
    checked = F.when(uneven | (n <= reach), F.raise_error(F.lit("trial too short to embed, or of uneven channels"))).otherwise(F.sequence(F.lit(reach), n - 1))
    lags = F.lit([k * lag_step for k in range(n_lags + 1)])
    at = lambda t: F.flatten(F.transform(lags, lambda k: F.transform("m", lambda c: F.get(c["s"], t - k))))
    return wide.select(*trial, F.inline(F.transform(checked, lambda t: F.struct(t.alias("t"), at(t).alias("x")))))


def differences(x: Column) -> Column:
    return F.transform(F.slice(x, 2, F.size(x) - 1), lambda v, i: v - F.get(x, i))


def variance(x: Column) -> Column:
    """Population variance of an array."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return let(mean(x), lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(x))


def hjorth(x: Column) -> Column:
    """``struct<mobility, complexity>``; degenerate signals give 0 (F1, F2)."""

    def of(d1: Column) -> Column:
        v0, v1, v2 = variance(x), variance(d1), variance(differences(d1))
        return let(F.struct(v0.alias("a"), v1.alias("b"), v2.alias("c")), ratio)

    def ratio(v: Column) -> Column:
        mobility = F.when(v["a"] < EPS, 0.0).otherwise(F.sqrt(v["b"] / v["a"]))
        complexity = F.when((v["b"] < EPS) | (mobility < EPS), 0.0).otherwise(F.sqrt(v["c"] / v["b"]) / mobility)
        return F.struct(mobility.alias("mobility"), complexity.alias("complexity"))

    return let(differences(x), of)


def histogram_entropy(x: Column, bins: int = 10) -> Column:
    """Shannon entropy in bits over equal bins of the range, the last one closed."""

    def of(r: Column) -> Column:
        index = F.transform(x, lambda v: F.least(F.floor((v - r["lo"]) / (r["hi"] - r["lo"]) * bins).cast("int"), F.lit(bins - 1)))
        def total(b: Column) -> Column:
            shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(b, lambda v: v == k)) / F.size(b))
            return F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
        return F.when(F.sqrt(variance(x)) < EPS, 0.0).otherwise(let(index, total))

    return let(F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi")), of)


def common_average(samples: DataFrame, at: list[str], value: str = "x") -> DataFrame:
    """Values less their mean over the channels at the same instant (PRE1)."""
    return samples.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*at)))


def relative_power(alpha: Column, theta: Column, beta: Column) -> Column:
    """Shares of three bands."""
    total = alpha + theta + beta + 1e-10
    return F.struct((alpha / total).alias("alpha"), (theta / total).alias("theta"), (beta / total).alias("beta"))


def asymmetry(left: Column, right: Column) -> Column:
    """``(R - L) / (R + L)``."""
    return (right - left) / (right + left + 1e-10)
