"""Diagnostics of feature matrices in long form ``(session, row, dim, x)`` and quality of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def label(value: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """Name of the first cut that a value reaches."""
    out = F.when(value >= cuts[0][0], cuts[0][1])
    for least, name in cuts[1:]:
        out = out.when(value >= least, name)
    return out.otherwise(otherwise)


def normality(long: DataFrame) -> DataFrame:
    """D'Agostino-Pearson ``k2`` and its p-value for each dimension of at least 8 values (DG5)."""
    m = long.groupBy("dim").agg(F.count("x").cast("double").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2")).where("n >= 8")
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    m = m.withColumn("w2", F.sqrt(2 * (beta2 - 1)) - 1).withColumn("y", g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / F.sqrt(2 / (F.col("w2") - 1)))
    m = m.withColumn("z1", F.asinh("y") / F.sqrt(0.5 * F.log("w2")))
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    m = m.withColumn("d", (g2 + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(spread)).withColumn("b", b)
    m = m.withColumn("a", 6 + 8 / F.col("b") * (2 / F.col("b") + F.sqrt(1 + 4 / F.col("b") ** 2)))
    a = F.col("a")
    m = m.withColumn("z2", (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + F.col("d") * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a)))
    return m.select("dim", (F.col("z1") ** 2 + F.col("z2") ** 2).alias("k2")).withColumn("p", F.exp(-F.col("k2") / 2))


def gaussianity(shape: DataFrame) -> DataFrame:
    """Score in 0..1 and label from ``skew, kurt, outliers, p`` (DG8, DG9)."""
    penalty = F.least(F.abs("skew") / 5, F.lit(0.35)) + F.least(F.abs("kurt") / 10, F.lit(0.30)) + F.least(5 * F.col("outliers"), F.lit(0.20))
    unlikely = F.when(F.col("p") < 1e-6, 0.15).when(F.col("p") < 1e-3, 0.10).when(F.col("p") < 0.05, 0.05).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - penalty - unlikely))
    return shape.withColumn("score", score).withColumn("label", label(F.col("score"), [(0.80, "excellent"), (0.65, "good"), (0.45, "acceptable"), (0.25, "poor")], "very_poor"))


#: What metadata may say of a feature, and the least score that agrees with it.
CONSISTENT = 0.65


def judged(shape: DataFrame, friendly: bool | Column | None = None) -> DataFrame:
    """``shape`` (``score, skew, kurt, outliers, sd``) with whether it agrees with the metadata, near-constancy and warnings (DG7, DG9).

    ``friendly`` is what the metadata say of all dimensions, or a column of it; null where they say nothing.
    """
    said = friendly if isinstance(friendly, Column) else F.lit(friendly).cast("boolean")
    agrees = (F.col("score") >= CONSISTENT) == said
    warned = [F.when(F.col("sd") < 1e-8, "constant"), F.when(F.abs("skew") > 2, "skew"), F.when(F.abs("kurt") > 5, "kurtosis"), F.when(F.col("outliers") > 0.05, "outliers"), F.when(F.col("score") < 0.40, "score")]
    return shape.withColumns({"consistent": agrees, "near_constant": F.col("sd") < 1e-8, "warnings": F.concat_ws(",", *warned)})


def smoothness(long: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Lag-1 correlation, mean step, spread and their ratio, by dimension within ``scope`` (DG10, DG14)."""
    w = Window.partitionBy(*scope, "dim").orderBy(order)
    steps = long.withColumn("prev", F.lag("x").over(w))
    step, sd = F.avg(F.abs(F.col("x") - F.col("prev"))), F.stddev_pop("x")
    known = F.when(F.col("prev").isNotNull(), F.col("x"))
    return steps.groupBy(*scope, "dim").agg(F.when(sd < EPS, 0.0).otherwise(F.corr(known, "prev")).alias("lag1"), step.alias("step"), (step / (sd + EPS)).alias("ratio"), sd.alias("sd"))


def smoothness_report(by_dim: DataFrame, scope: list[str]) -> DataFrame:
    """Means and deviations of ``smoothness`` over dimensions, noise ratio and label (DG10)."""
    found = by_dim.groupBy(*scope).agg(
        F.avg("lag1").alias("lag1_mean"), F.stddev_pop("lag1").alias("lag1_sd"), F.avg("step").alias("step_mean"), F.stddev_pop("step").alias("step_sd"),
        (F.avg("step") / (F.avg("sd") + EPS)).alias("noise"),
    )
    m = F.col("lag1_mean")
    return found.withColumn("label", F.when(m > 0.85, "very_smooth").when(m > 0.65, "smooth").when(m > 0.40, "moderate").otherwise("noisy"))


def stationarity(long: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Trend of each dimension within ``scope`` and the shift between its first and last tenth (DG11)."""
    w = Window.partitionBy(*scope, "dim")
    placed = long.withColumn("t", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    edge = F.greatest(F.lit(5), F.floor(F.col("n") / 10))
    first, last = F.avg(F.when(F.col("t") < edge, F.col("x"))), F.avg(F.when(F.col("t") >= F.col("n") - edge, F.col("x")))
    return placed.groupBy(*scope, "dim").agg(F.regr_slope("x", "t").alias("slope"), F.abs(last - first).alias("shift"))


def stationarity_report(by_dim: DataFrame, scope: list[str]) -> DataFrame:
    """Mean trend, its deviation, mean shift and label over dimensions (DG11)."""
    found = by_dim.groupBy(*scope).agg(F.avg("slope").alias("slope_mean"), F.stddev_pop("slope").alias("slope_sd"), F.avg("shift").alias("shift_mean"))
    slope = F.abs("slope_mean")
    return found.withColumn("label", F.when((slope < 1e-4) & (F.col("shift_mean") < 0.1), "stationary").when(slope < 1e-3, "quasi_stationary").otherwise("non_stationary"))


#: Critical values of the level statistic at these probabilities.
KPSS_AT = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def kpss(long: DataFrame, scope: list[str], order: str, lags: int | None = None) -> DataFrame:
    """Level stationarity of each dimension within ``scope``: statistic and its probability between 0.01 and 0.10 (DG12).

    The long-run variance has Bartlett weights over ``lags`` lags, by default a fixed power of the length.  A series is one
    array in one task; ``lags.kpss_auto`` cuts long ones into chunks and lets them determine the lags.
    """
    w = Window.partitionBy(*scope, "dim")
    centred = long.select(*scope, "dim", F.col(order).alias("o"), (F.col("x") - F.avg("x").over(w)).alias("e"))
    series = centred.groupBy(*scope, "dim").agg(F.array_sort(F.collect_list(F.struct("o", "e"))).alias("_s")).select(*scope, "dim", F.col("_s.e").alias("e"))
    n = F.size("e")
    most = F.lit(lags) if lags is not None else F.floor(4 * F.pow(n / 100, F.lit(0.25))).cast("int")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    square = lambda a: add(F.transform(a, lambda v: v * v))
    sums = F.aggregate("e", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda t, v: F.struct((t["s"] + v).alias("s"), (t["q"] + (t["s"] + v) * (t["s"] + v)).alias("q")))["q"]
    cross = lambda k: add(F.zip_with(F.slice("e", F.lit(1), n - k), F.slice("e", k + 1, n - k), lambda a, b: a * b))
    tail = add(F.transform(F.filter(F.sequence(F.lit(0), most), lambda k: (k > 0) & (k < n)), lambda k: 2 * (1 - k / (most + 1)) * cross(k)))
    found = series.select(*scope, "dim", (sums / (n * n) / ((square(F.col("e")) + tail) / n)).alias("kpss"))
    p = F.when(F.col("kpss") <= KPSS_AT[0][0], KPSS_AT[0][1])
    for (a, pa), (b, pb) in zip(KPSS_AT, KPSS_AT[1:], strict=False):
        p = p.when(F.col("kpss") <= b, pa + (F.col("kpss") - a) / (b - a) * (pb - pa))
    return found.withColumn("p", p.otherwise(KPSS_AT[-1][1]))


def between_sessions(long: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Variance within and between sessions, over as many values of each as the shortest has (DG21)."""
    placed = long.withColumn("t", F.row_number().over(Window.partitionBy(session).orderBy(*order)))
    shortest = long.groupBy(session).count().agg(F.min("count").alias("least"))
    by = placed.join(F.broadcast(shortest), F.col("t") <= F.col("least")).groupBy(session).agg(F.var_pop("x").alias("v"), F.avg("x").alias("m"))  # one row
    all_ = by.agg(F.avg("v").alias("within"), F.var_pop("m").alias("between")).withColumn("ratio", F.col("between") / (F.col("within") + EPS))
    name = F.when(F.col("fingerprint") < 0.15, "low").when(F.col("fingerprint") < 0.35, "moderate").when(F.col("fingerprint") < 0.60, "high").otherwise("extreme")
    return all_.withColumn("fingerprint", F.col("ratio") / (1 + F.col("ratio"))).withColumn("label", F.concat(name, F.lit("_subject_signature")))


def reject_artefacts(epochs: DataFrame, trial: list[str], most: float, samples: str = "samples") -> DataFrame:
    """Epochs without those of trials in which some channel's peak-to-peak range is over ``most`` (PRE4)."""
    span = F.array_max(samples) - F.array_min(samples)
    bad = epochs.groupBy(*trial).agg(F.max(span).alias("span")).where(F.col("span") > most)
    return epochs.join(bad, trial, "left_anti")


def channel_levels(long: DataFrame, by: list[str] | None = None, most: float = 2.0) -> DataFrame:
    """RMS and variance of each channel, and whether its RMS is over ``most`` deviations from those of its group's (QC1, QC6)."""
    groups = by or []
    found = long.groupBy(*groups, "dim").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.var_pop("x").alias("variance"))
    w = Window.partitionBy(*(groups or [F.lit(0)]))  # one row a channel
    return found.withColumn("bad", F.abs((F.col("rms") - F.avg("rms").over(w)) / F.stddev_pop("rms").over(w)) > most)


def amplitudes(epochs: DataFrame, session: str, high: float, low: float) -> DataFrame:
    """Greatest amplitude of a session's epochs, and how many are over either level (QC2)."""
    top = F.greatest(F.array_max("samples"), -F.array_min("samples"))
    return epochs.groupBy(session).agg(F.max(top).alias("top"), F.count_if(top > high).alias("n_high"), F.count_if(top > low).alias("n_low"), F.count(F.lit(1)).alias("n_epochs"),
                                       (100 * F.avg((top > high).cast("double"))).alias("pct_high"), (100 * F.avg((top > low).cast("double"))).alias("pct_low"))


def band_power(psd: DataFrame, by: list[str], lo: float, hi: float) -> DataFrame:
    """Trapezoid of ``(f, p)`` over the closed band ``lo..hi`` (QC4)."""
    w = Window.partitionBy(*by).orderBy("f")
    area = (F.lead("f").over(w) - F.col("f")) * (F.lead("p").over(w) + F.col("p")) / 2
    return psd.where(F.col("f").between(lo, hi)).withColumn("area", area).groupBy(*by).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("power"))


def band_ratios(alpha: Column, theta: Column, beta: Column) -> list[Column]:
    """Log ratios theta/alpha, alpha/beta, theta/beta (F8)."""
    a, t, b = (F.log(F.abs(v) + 1e-10) for v in (alpha, theta, beta))
    return [(t - a).alias("theta_alpha"), (a - b).alias("alpha_beta"), (t - b).alias("theta_beta")]


def trial_mean(epochs: DataFrame, by: list[str], samples: str = "samples") -> DataFrame:
    """The mean signal over the trials of each group, such as a session's channel; it goes before a spectrum (QC3)."""
    placed = epochs.select(*by, F.posexplode(samples).alias("t", "x")).groupBy(*by, "t").agg(F.avg("x").alias("x"))
    return placed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("_w")).select(*by, F.col("_w.x").alias(samples))


def power_ratios(psd: DataFrame, session: str, channel: str) -> DataFrame:
    """Beta and theta over alpha, averaged over a session's channels, and the share of 20 to 45 Hz in all from 1 Hz on (QC5, QC7)."""
    by = [session, channel]
    powers = band_power(psd, by, 8.0, 13.0).withColumnRenamed("power", "alpha")
    for name, lo, hi in (("beta", 13.0, 30.0), ("theta", 4.0, 8.0)):
        powers = powers.join(band_power(psd, by, lo, hi).withColumnRenamed("power", name), by)
    ratios = powers.groupBy(session).agg(F.avg(F.col("beta") / (F.col("alpha") + 1e-30)).alias("beta_alpha"), F.avg(F.col("theta") / (F.col("alpha") + 1e-30)).alias("theta_alpha"))
    mean = psd.groupBy(session, "f").agg(F.avg("p").alias("p"))
    emg = band_power(mean, [session], 20.0, 45.0).withColumnRenamed("power", "high").join(band_power(mean, [session], 1.0, float("inf")), session)
    return ratios.join(emg.select(session, (F.col("high") / (F.col("power") + 1e-30)).alias("emg")), session)


def signal_verdict(quality: DataFrame, rms_yellow: float, rms_red: float) -> DataFrame:
    """``quality`` (``rms, emg, pct_high, pct_low, n_bad``) with flags of level and muscle and the verdict (QC7, QC8)."""
    c = F.col
    flag = lambda v, yellow, red: F.when(v > red, "red").when(v > yellow, "yellow").otherwise("green")
    out = quality.withColumns({"rms_flag": flag(c("rms"), rms_yellow, rms_red), "emg_flag": flag(c("emg"), 0.20, 0.35)})
    red = (c("rms_flag") == "red") | (c("emg_flag") == "red") | (c("pct_high") > 10)
    yellow = (c("rms_flag") == "yellow") | (c("emg_flag") == "yellow") | (c("n_bad") > 2) | (c("pct_low") > 20)
    return out.withColumn("verdict", F.when(red & ((c("n_bad") > 2) | (c("emg") > 0.35)), "Artefacto").when(red | yellow, "Atípico").otherwise("OK"))


def reference_spectrum(psd: DataFrame) -> DataFrame:
    """Mean and both edges of one deviation of ``(f, p)`` over all its rows, in decibels (QC9)."""
    db = lambda v: 10 * F.log10(F.greatest(v, F.lit(1e-30)))
    mu, sd = F.avg("p"), F.stddev_pop("p")
    return psd.groupBy("f").agg(db(mu).alias("mean_db"), db(mu - sd).alias("low_db"), db(mu + sd).alias("high_db"))
