"""Statistics of feature matrices in long form ``(row, dim, x)`` and of groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesostate.operators.orderstats import quantiles
from mesostate.storage import checkpoint


def scaler(long: DataFrame) -> DataFrame:
    """Mean and population scale of each dimension; a scale of 0 counts as 1 (M1)."""
    sd = F.stddev_pop("x")
    return long.groupBy("dim").agg(F.avg("x").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("scale"))


def distribution(long: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Moments, adjusted skewness and kurtosis, quantiles of each dimension (DG3, DG4).

    Quantiles are exact, by rounds of counts in bounded memory; ``long`` is read in each.  With an ``accuracy`` they are
    approximate, with an error of at most one in ``accuracy`` ranks, and ``long`` is read once.
    """
    n, g1, g2 = F.count("x"), F.skewness("x"), F.kurtosis("x")
    at = {"median": 0.5, "p01": 0.01, "p99": 0.99}
    near = [] if accuracy is None else [F.percentile_approx("x", q, accuracy).alias(name) for name, q in at.items()]
    finite = long.where("x = x AND abs(x) < double('infinity')")
    found = finite.groupBy("dim").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        (g1 * F.sqrt(n * (n - 1.0)) / (n - 2)).alias("skew"), ((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6)).alias("kurt"), *near,
    )
    whole = found if accuracy is not None else found.join(quantiles(finite, ["dim"], "x", at), "dim")
    return whole.select("dim", "mean", "sd", "median", "lo", "hi", "p01", "p99", "skew", "kurt")


def outliers(long: DataFrame, least: float = 3.0) -> DataFrame:
    """Share of values over ``least`` deviations from the mean (DG6)."""
    fitted = long.join(F.broadcast(scaler(long)), "dim")  # one row a dimension
    return fitted.groupBy("dim").agg(F.avg((F.abs((F.col("x") - F.col("mean")) / F.col("scale")) > least).cast("double")).alias("share"))


def standardised(long: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """``long`` with ``z`` by a fitted scaler, its own by default (M1)."""
    known = scaler(long) if fitted is None else fitted
    return long.join(F.broadcast(known), "dim").withColumn("z", (F.col("x") - F.col("mean")) / F.col("scale")).drop("mean", "scale")  # one row a dimension


def correlations(rows: DataFrame, x: str = "x") -> DataFrame:
    """``i, j, r`` with i < j: Pearson correlation of each pair of places of the arrays in ``x``, from centred co-moments (DG15, DG16).

    One pass over the rows; a number for each pair of dimensions reaches the driver.  A constant dimension has r null.
    """
    from mesostate.operators.models import co_moments

    _, mean, moments = co_moments(rows, x)
    spread = np.sqrt(np.diag(moments))
    spread[spread <= np.abs(mean) * 1e-13] = 0  # what rounding leaves of a constant
    with np.errstate(all="ignore"):
        r = np.clip(moments / np.outer(spread, spread), -1, 1)
    found = [(int(i), int(j), float(r[i, j]) if np.isfinite(r[i, j]) else None) for i, j in zip(*np.triu_indices(len(r), 1), strict=True)]
    return rows.sparkSession.createDataFrame(found, "i int, j int, r double")


def redundant(pairs: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs of at least ``least`` correlation either way, with their grade, strongest first (DG15)."""
    strength = F.abs("r")
    grade = F.when(strength >= 0.95, "extreme").when(strength >= 0.90, "high").otherwise("moderate")
    return pairs.where(strength >= least).withColumn("grade", grade).orderBy(F.desc(strength), "i", "j")


def centroids(long: DataFrame, group: str) -> DataFrame:
    return long.groupBy(group, "dim").agg(F.avg("x").alias("m"))


def centroid_distances(long: DataFrame, group: str) -> DataFrame:
    """Euclidean distance between group centroids (DG22, M11)."""
    c = centroids(long, group)
    other = c.select(F.col(group).alias("b"), "dim", F.col("m").alias("mb"))
    return c.join(other, "dim").where(F.col(group) < F.col("b")).groupBy(F.col(group).alias("a"), "b").agg(F.sqrt(F.sum((F.col("m") - F.col("mb")) ** 2)).alias("distance"))


def separability(distances: DataFrame) -> DataFrame:
    """Mean, deviation and range of the distances of groups, and what they are called (DG22)."""
    d = F.col("distance")
    found = distances.agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.min(d).alias("least"), F.max(d).alias("most"))
    m = F.col("mean")
    return found.withColumn("label", F.when(m < 0.5, "subjects_overlap").when(m < 2.0, "moderate_subject_separation").otherwise("strong_subject_separation"))


def geometry(long: DataFrame, group: str) -> DataFrame:
    """Norm of each group's centroid and mean and greatest covariance of its dimensions' variances."""
    by = long.groupBy(group, "dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return by.groupBy(group).agg(F.sqrt(F.sum(F.col("m") ** 2)).alias("norm"), F.avg("v").alias("mean_variance"), F.max("v").alias("most_variance"))


def centring_impact(long: DataFrame, group: str) -> DataFrame:
    """Share of a dimension's variance that group means explain, and what that is called (DG23)."""
    centred = long.withColumn("c", F.col("x") - F.avg("x").over(Window.partitionBy(group, "dim")))
    found = centred.groupBy("dim").agg((1 - F.var_pop("c") / (F.var_pop("x") + 1e-12)).alias("impact"))
    r = F.col("impact")
    return found.withColumn("label", F.when(r < 0.10, "minimal_subject_bias").when(r < 0.30, "moderate_subject_bias").otherwise("strong_subject_bias"))


def running_before(counts: DataFrame, value: str, n: str, into: str) -> DataFrame:
    """``counts`` with the sum of ``n`` over all lesser values, by range partitions: no task sees more than its range.

    ``counts`` has one row a value.  Only a sum a partition is ordered in one place.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(counts.repartitionByRange(parts, value).sortWithinPartitions(value).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(n).alias("_sum"))
    whole = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(into, within).join(F.broadcast(sums.select("_part", whole.alias("_base"))), "_part").withColumn(into, F.col(into) + F.col("_base")).drop("_part", "_base")  # one row a partition


def erfc(x: Column) -> Column:
    """What the error function of a number lacks to 1: by the power series up to 3, by a continued fraction beyond, so small values keep their digits."""
    def of(a: Column) -> Column:
        term = lambda acc, k: acc["t"] * -1.0 * a * a / k
        start = F.struct(a.alias("t"), a.alias("s"))
        near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, lambda acc, k: F.struct(term(acc, k).alias("t"), (acc["s"] + term(acc, k) / (2 * k + 1)).alias("s")))["s"]
        tail = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(0.0), lambda acc, k: k / 2.0 / (a + acc))
        return F.when(a < 3, 1 - near * (2 / np.sqrt(np.pi))).otherwise(F.exp(-a * a) / (np.sqrt(np.pi) * (a + tail)))

    found = F.transform(F.array(F.abs(x)), of)[0]
    return F.when(x < 0, 2 - found).otherwise(found)


def erf(x: Column) -> Column:
    """Error function of a number; absolute error under 1e-10."""
    return F.signum(x) * (1 - erfc(F.abs(x)))


def mann_whitney(values: DataFrame, side: str, value: str) -> DataFrame:
    """U of the rows with ``side`` true, both numbers of rows, and the two-sided p-value (STAT1).

    Ranks of ties are averaged; p is of the normal approximation, corrected for ties and continuity.
    """
    counts = values.groupBy(value).agg(F.sum(F.col(side).cast("long")).alias("n1"), F.count(F.lit(1)).alias("n"))
    ranked = running_before(counts, value, "n", "before").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    n1, n = F.sum("n1"), F.sum("n")
    ties = F.sum(F.col("n").cast("double") ** 3 - F.col("n"))
    found = ranked.agg((F.sum(F.col("n1") * F.col("rank")) - n1 * (n1 + 1) / 2).alias("u"), n1.alias("n1"), (n - n1).alias("n2"), ties.alias("ties"))
    c = F.col
    total = c("n1") + c("n2")
    sd = F.sqrt(c("n1") * c("n2") / 12.0 * (total + 1 - c("ties") / (total * (total - 1.0))))
    far = F.greatest(F.abs(c("u") - c("n1") * c("n2") / 2) - 0.5, F.lit(0.0))
    return found.withColumn("z", F.when(sd > 0, far / sd)).withColumn("p", erfc(c("z") / float(np.sqrt(2)))).drop("ties")
