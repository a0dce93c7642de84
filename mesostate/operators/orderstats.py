"""Exact order statistics of many groups at once, in bounded memory.

Each wanted rank has an interval of values that holds it, at first all of its
group.  A round counts the values of every open interval in bins and goes on with the bin of the
rank, from its least to its greatest value.  Bins are of equal width in one round and of equal ratio in
the next, so neither close values nor values of very different size take many rounds.  Once an interval has few
values they are sorted.  No task holds more than the bins of an interval or those few values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesostate.storage import checkpoint

#: Bins of a round, values that are sorted at last, rows of intervals that are broadcast.
BINS, FEW, MOST_BROADCAST = 1024, 2048, 200_000


def _place(x: Column, lo: Column, hi: Column, ratio: bool) -> Column:
    """Bin of a value in ``lo..hi``; it never falls as the value rises."""
    if ratio:
        # on the scale of powers of two of the distance from 0, with the sign in front
        scale = lambda v: F.signum(v) * F.greatest(F.lit(0.0), F.log2(F.abs(v)) + 1075.0)
        x, lo, hi = F.when(x == 0, 0.0).otherwise(scale(x)), F.when(lo == 0, 0.0).otherwise(scale(lo)), F.when(hi == 0, 0.0).otherwise(scale(hi))
    share = F.when(hi > lo, (x / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise(0.0)
    return F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """``by, rank, value``: the value of each rank, from 0, of each group in ``ranks`` (``by, rank``).

    Values are finite doubles: null, NaN and infinite ones are left out beforehand.  Ranks outside a group have no row.
    ``df`` is read in every round: checkpoint what is costly to make.
    """
    x = F.col(value).cast("double")
    data = df.select(*by, x.alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x) AND abs(_x) < double('infinity')")
    whole = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    first = ranks.select(*by, F.col("rank").cast("long")).distinct().join(whole, by).where("rank >= 0 AND rank < n")
    state = checkpoint(first.withColumn("k", F.col("rank")))
    turn = 0

    def inside(open_: DataFrame) -> DataFrame:
        """Values of open intervals, with the interval."""
        wanted = open_.select(*by, "lo", "hi").distinct()
        small = open_.count() <= MOST_BROADCAST
        return data.join(F.broadcast(wanted) if small else wanted, by).where("_x >= lo AND _x <= hi")

    while True:
        open_ = state.where(f"lo < hi AND n > {FEW}")
        if open_.isEmpty():
            break
        bins = inside(open_).withColumn("bin", _place(F.col("_x"), F.col("lo"), F.col("hi"), turn % 2 == 1))
        counts = bins.groupBy(*by, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        before = F.sum("_n").over(Window.partitionBy(*by, "lo", "hi").orderBy("bin")) - F.col("_n")  # as many rows as bins
        found = open_.join(counts.withColumn("_before", before), [*by, "lo", "hi"]).where("k >= _before AND k < _before + _n")
        narrowed = found.select(*by, "rank", F.col("_n").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("k") - F.col("_before")).alias("k"))
        state = checkpoint(narrowed.unionByName(state.where(f"NOT (lo < hi AND n > {FEW})")))
        turn += 1
    few = state.where("lo < hi")
    listed = inside(few).groupBy(*by, "lo", "hi").agg(F.array_sort(F.collect_list("_x")).alias("_v"))  # FEW values at most
    last = few.join(listed, [*by, "lo", "hi"]).select(*by, "rank", F.element_at("_v", (F.col("k") + 1).cast("int")).alias("value"))
    return state.where("lo = hi").select(*by, "rank", F.col("lo").alias("value")).unionByName(last)


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``by`` and a column for each name in ``at``: exact quantiles, linear between neighbouring values, as ``percentile`` gives them."""
    x = F.col(value).cast("double")
    data = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sizes = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(float(q))).alias("pos")) for name, q in at.items()]))
    wanted = checkpoint(sizes.select(*by, asked.alias("_q")).select(*by, "_q.name", "_q.pos"))
    ends = wanted.select(*by, F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank"))
    found = checkpoint(order_statistics(data, by, value, ends))
    low = found.select(*by, F.col("rank").alias("_a"), F.col("value").alias("_lo"))
    high = found.select(*by, F.col("rank").alias("_b"), F.col("value").alias("_hi"))
    both = wanted.withColumns({"_a": F.floor("pos"), "_b": F.ceil("pos")}).join(low, [*by, "_a"]).join(high, [*by, "_b"])
    between = (F.col("_b") - F.col("pos")) * F.col("_lo") + (F.col("pos") - F.col("_a")) * F.col("_hi")
    exact = both.withColumn("_v", F.when((F.col("_a") == F.col("_b")) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise(between))
    return exact.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in at])
