"""Judgements on decoded states: wide tables, persistence, confidence, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide(occupancy: DataFrame, dwell: DataFrame, session: str, names: list[str], absent: float | None = None) -> DataFrame:
    """One row a session with ``fo_<state>`` and ``dwell_<state>`` of the named states; ``absent`` is the dwell of one not visited (ST3)."""
    both = occupancy.join(dwell, [session, "state"], "left")
    pick = lambda s, c: F.max(F.when(F.col("state") == s, F.col(c)))
    fo = [F.coalesce(pick(s, "fo"), F.lit(0.0)).alias(f"fo_{s}") for s in names]
    return both.groupBy(session).agg(*fo, *[F.coalesce(pick(s, "dwell_sec"), F.lit(absent).cast("double")).alias(f"dwell_{s}") for s in names])


def dwell_statistics(runs: DataFrame, step: float) -> DataFrame:
    """Mean, median and 95th percentile of the run lengths of each state, in ``step`` units (ST7, ST8).

    Runs are of whatever scope they were cut in: one trial, one session, or the whole path.  Exact percentiles hold a number a
    distinct length, of which ``n`` windows have at most ``sqrt(2 n)``.
    """
    ms = F.col("length") * step
    return runs.groupBy("state").agg(F.avg(ms).alias("mean"), F.percentile(ms, 0.5).alias("median"), F.percentile(ms, 0.95).alias("p95"), F.count(F.lit(1)).alias("n_runs"), F.sum("length").alias("n_windows"))


def state_table(decoded: DataFrame, runs: DataFrame, matrix: DataFrame, step: float) -> DataFrame:
    """All figures of each state: hard and soft occupancy, persistence, dwell, confidence, entropy, flag (ST7).

    ``decoded`` has ``state`` and ``posterior``, an array by state number; ``matrix`` has ``i, j, p``.
    """
    entropy, _, top, _ = soft(F.col("posterior"))
    windows = decoded.select("state", entropy, top)
    hard = windows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg("entropy").alias("entropy"))
    mean = decoded.select(F.posexplode("posterior").alias("state", "p")).groupBy("state").agg(F.avg("p").alias("fo_soft"), F.count(F.lit(1)).alias("total"))
    table = mean.join(hard, "state", "left").join(attractors(matrix, step), "state", "left").join(dwell_statistics(runs, step).drop("n_windows"), "state", "left")
    return table.select(
        "state", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("fo_hard"), "fo_soft", F.coalesce("self", F.lit(0.0)).alias("self_trans"),
        F.coalesce("dwell", F.lit(step)).alias("dwell_analytic"), F.coalesce("median", F.lit(0.0)).alias("dwell_median"), F.coalesce("mean", F.lit(0.0)).alias("dwell_mean"),
        F.coalesce("p95", F.lit(0.0)).alias("dwell_p95"), "confidence", "entropy", F.coalesce("n", F.lit(0)).cast("long").alias("n_windows"),
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"), F.when(F.col("attractor"), "ATRACTOR").otherwise("OK").alias("flag"),
    )


def attractors(matrix: DataFrame, step: float) -> DataFrame:
    """Self-transition, analytic dwell and attractor flag of each state of ``(i, j, p)`` (ST9, ST10)."""
    stay = F.coalesce(F.max(F.when(F.col("i") == F.col("j"), F.col("p"))), F.lit(0.0))
    own = matrix.groupBy(F.col("i").alias("state")).agg(stay.alias("self"))
    return own.withColumn("dwell", step / F.greatest(1 - F.col("self"), F.lit(1e-9))).withColumn("attractor", (F.col("self") > 0.97) | (F.col("dwell") > 5000))


def most_persistent(matrix: DataFrame) -> DataFrame:
    """The state of the greatest self-transition, the least name on ties (ST22)."""
    return matrix.where("i = j").select(F.col("i").alias("state"), "p").orderBy(F.desc("p"), "state").limit(1)


def soft(posterior: Column) -> tuple[Column, Column, Column, Column]:
    """Entropy, its share of the greatest, confidence and regime of an array of probabilities (ST11, ST23, ST24)."""
    entropy = F.aggregate(posterior, F.lit(0.0), lambda s, p: s - p * F.log(p + 1e-12))
    top = F.array_max(posterior)
    return entropy.alias("entropy"), (entropy / F.log(F.size(posterior))).alias("relative"), top.alias("confidence"), F.when(top > 0.85, "discrete").when(top > 0.65, "metastable").otherwise("continuous").alias("regime")


def absorbing(occupancy: DataFrame, over: float = 0.95) -> DataFrame:
    """Sessions that spend over ``over`` of their windows in one state (ST13)."""
    return occupancy.where(F.col("fo") > over)


def quality(states: DataFrame) -> DataFrame:
    """Score 0 to 4 and verdict of a table ``state, fo, dwell, confidence`` (ST14)."""
    met = lambda c: c.cast("int")
    least, most = F.min("fo"), F.max("fo")
    score = met(least >= 0.10) + met(F.max("dwell") <= 2000) + met(most - least <= 0.30) + met(F.avg("confidence") >= 0.60)
    return states.agg(score.alias("score")).withColumn("verdict", verdict(F.col("score")))


def verdict(score: Column) -> Column:
    return F.when(score == 4, "REPORTAR").when(score == 3, "ACEPTABLE").otherwise("REVISAR")


def health(states: DataFrame, confidence: Column, absorbing: Column, larger: Column, smaller: Column) -> DataFrame:
    """Checks of an experiment as rows ``item, grade, value`` (STAT4, STAT5).

    ``states`` has ``state, fo, self_trans, dwell_analytic`` and, the same in each row, what the other arguments read:
    mean confidence, absorbing sessions, and the sessions of the larger and smaller condition.
    """
    lasting = (F.col("self_trans") > 0.97) | (F.col("dwell_analytic") > 5000)
    each = states.select(F.concat(F.lit("dwell "), F.col("state").cast("string")).alias("item"), F.when(lasting, "critical").otherwise("ok").alias("grade"), F.col("dwell_analytic").alias("value"))
    one = states.agg(F.min("fo").alias("least"), (F.max("fo") - F.min("fo")).alias("range"), F.max(confidence).alias("sure"), F.max(absorbing).cast("double").alias("absorbing"), F.max(larger / smaller).alias("ratio"))
    item = lambda name, grade, value: F.struct(F.lit(name).alias("item"), grade.alias("grade"), value.alias("value"))
    c = F.col
    rows = F.array(
        item("fo balance", F.when(c("least") < 0.10, "critical").otherwise("ok"), F.when(c("least") < 0.10, c("least")).otherwise(c("range"))),
        item("confidence", F.when(c("sure") > 0.80, "ok").when(c("sure") > 0.60, "warning").otherwise("critical"), c("sure")),
        item("absorbing", F.when(c("absorbing") == 0, "ok").when(c("absorbing") <= 3, "warning").otherwise("critical"), c("absorbing")),
        item("condition balance", F.when(c("ratio") < 1.3, "ok").otherwise("warning"), c("ratio")),
    )
    return each.unionByName(one.select(F.inline(rows)))


def fit_for_report(checks: DataFrame) -> DataFrame:
    """Number of checks of each grade and what they say of the experiment (STAT5)."""
    n = lambda grade: F.count_if(F.col("grade") == grade).alias(grade)
    found = checks.agg(n("ok"), n("warning"), n("critical"))
    return found.withColumn("verdict", F.when(F.col("critical") > 0, "correct first").when(F.col("warning") <= 1, "report").otherwise("acceptable"))


def profile(path: DataFrame, position: str) -> DataFrame:
    """Share of each state at each position of a trial (EV6)."""
    counts = path.groupBy(position, "state").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(position, "state", (F.col("n") / F.sum("n").over(Window.partitionBy(position))).alias("p"))
