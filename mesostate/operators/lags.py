"""Level stationarity of series of any length, with lags that the series itself determines.

A series is numbered through range partitions and cut into chunks of consecutive steps; sums of a chunk are combined by
the chunks before it, and products at a lag reach into the head of the next chunk.  No task holds more than
a chunk and its overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mesostate.operators.diagnostics import KPSS_AT
from mesostate.storage import checkpoint

#: Steps of a chunk, at least; a chunk is as long as the greatest lag.
CHUNK = 16_384


def numbered(df: DataFrame, by: list[str], order: list[str], into: str = "t") -> DataFrame:
    """``df`` with the place of each row in its group, from 0, by range partitions: a group may span any number of tasks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")  # a row a partition
    here = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1
    return placed.withColumn("_here", here).join(counts.select(*by, "_part", before.alias("_before")), [*by, "_part"]).withColumn(into, F.col("_here") + F.col("_before")).drop("_part", "_here", "_before")


def _chunks(placed: DataFrame, by: list[str], size: int) -> DataFrame:
    """``by, chunk, n, e, base``: chunks of the series less its mean, and the sum of all earlier ones."""
    listed = placed.groupBy(*by, F.expr(f"t div {size}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("_w"))
    chunks = listed.select(*by, "chunk", F.col("_w.x").alias("x")).withColumn("_s", F.aggregate("x", F.lit(0.0), lambda s, v: s + v))
    w = Window.partitionBy(*by)  # a row a chunk
    with_mean = chunks.withColumn("n", F.sum(F.size("x")).over(w)).withColumn("_mean", F.sum("_s").over(w) / F.col("n"))
    less = with_mean.withColumn("e", F.transform("x", lambda v: v - F.col("_mean"))).drop("x", "_s", "_mean")
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    return checkpoint(less.withColumn("_s", total).withColumn("base", F.sum("_s").over(w.orderBy("chunk")) - F.col("_s")).drop("_s"))


def _weighted_products(chunks: DataFrame, by: list[str], lag: str, weights: str) -> DataFrame:
    """``by, s0, s1``: sums over lags 1 to ``lag`` of the products of a series with itself, each times a weight, by Fourier transforms.

    ``weights`` ``plain`` gives the sum of products and that of lag times product; ``bartlett`` the sum with falling weights.
    """
    head = chunks.select(*by, (F.col("chunk") - 1).alias("chunk"), F.slice("e", F.lit(1), F.col(lag).cast("int")).alias("head"))
    both = chunks.join(head, [*by, "chunk"], "left").withColumn("head", F.coalesce("head", F.array().cast("array<double>")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*by).schema) + ", s0 double, s1 double"

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for e, after, most in zip(batch["e"], batch["head"], batch[lag], strict=True):
                e, most = np.asarray(e), int(most)
                longer = np.concatenate([e, np.asarray(after)])
                size = 1 << int(len(longer) + len(e)).bit_length()
                r = np.fft.irfft(np.conj(np.fft.rfft(e, size)) * np.fft.rfft(longer, size), size)[1 : most + 1]
                k = np.arange(1, len(r) + 1)
                out.append((r.sum(), (k * r).sum()) if weights == "plain" else (((1 - k / (most + 1)) * r).sum(), 0.0))
            yield batch[by].assign(s0=[v[0] for v in out], s1=[v[1] for v in out])

    return both.mapInPandas(products, kinds).groupBy(*by).agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))


def kpss_auto(long: DataFrame, scope: list[str], order: str) -> DataFrame:
    """``scope, dim, lags, kpss, p``: level stationarity with the automatic bandwidth of Hobijn, Franses and Ooms (DG12).

    The first ``n^(2/9)`` autocovariances determine the number of lags, ``1.1447 (s1/s0)^(2/3) n^(1/3)`` and at most
    ``n - 1``, of the long-run variance.  The probability lies between 0.01 and 0.10.  A series without variance, or whose first
    autocovariances cancel it, has neither.
    """
    by = [*scope, "dim"]
    placed = checkpoint(numbered(long.select(*by, F.col(order).alias("_o"), F.col("x").cast("double").alias("x")), by, ["_o"]))
    longest = placed.agg(F.max("t")).first()[0]
    few = int(((longest or 0) + 1) ** (2 / 9)) + 1
    chunks = _chunks(placed, by, max(CHUNK, few))
    n = F.col("n")
    square = F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v)
    path = F.aggregate("e", F.struct(F.col("base").alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + (a["s"] + v) * (a["s"] + v)).alias("q")))["q"]
    sums = checkpoint(chunks.groupBy(*by, "n").agg(F.sum(square).alias("square"), F.sum(path).alias("path")))
    counted = chunks.withColumn("lag", F.floor(F.pow(n.cast("double"), F.lit(2 / 9)) + 1e-9))
    near = _weighted_products(counted, by, "lag", "plain")
    some = lambda v: F.when(F.abs(v) > 1e-12 * F.col("square") / n, v)  # noqa: E731  (more than rounding leaves)
    s0, s1 = some(F.col("square") / n + 2 * F.col("s0") / n), 2 * F.col("s1") / n
    gamma = 1.1447 * F.pow((s1 / s0) * (s1 / s0), F.lit(1 / 3))
    lags = F.when(gamma.isNotNull(), F.least(F.floor(gamma * F.pow(n.cast("double"), F.lit(1 / 3))), n - 1))
    chosen = checkpoint(sums.join(near, by).where("square > 0").select(*by, "n", "square", "path", lags.alias("lags")).where("lags IS NOT NULL"))
    most = chosen.agg(F.max("lags")).first()[0] or 0
    if most > CHUNK:
        chunks = _chunks(placed, by, int(most))
    far = _weighted_products(chunks.join(chosen.select(*by, "lags"), by), by, "lags", "bartlett")
    variance = some((F.col("square") + 2 * F.col("s0")) / n)
    found = chosen.join(far, by).select(*by, F.col("lags").cast("long"), (F.col("path") / (n * n) / variance).alias("kpss"))
    p = F.when(F.col("kpss") <= KPSS_AT[0][0], KPSS_AT[0][1])
    for (a, pa), (b, pb) in zip(KPSS_AT, KPSS_AT[1:], strict=False):
        p = p.when(F.col("kpss") <= b, pa + (F.col("kpss") - a) / (b - a) * (pb - pa))
    return sums.select(*by).join(found.withColumn("p", p.otherwise(KPSS_AT[-1][1])), by, "left")
