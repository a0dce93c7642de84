"""State-path analytics: occupancy, runs, dwell times, transitions, evoked profiles.

A state path is a DataFrame with a scope (the columns within which runs may
extend), an order and a state column.  All operators partition by the scope
once; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesostate.storage import checkpoint


def on_grid(found: DataFrame, by: list[str], state: str = "state", *zero: str) -> DataFrame:
    """``found`` (one row a group and state) with a row for each state in each group; ``zero`` columns are 0 there, others null.

    ``found`` is checkpointed, as its groups, its states and its rows are all needed.  The states are one array in one row, as
    there are a handful of them.
    """
    found = checkpoint(found)
    names = found.agg(F.array_sort(F.collect_set(state)).alias("_states"))
    grid = found.select(*by).distinct().crossJoin(F.broadcast(names)).select(*by, F.explode("_states").alias(state))  # one row
    return grid.join(found, [*by, state], "left").na.fill(0, list(zero))


def visits(path: DataFrame, scope: list[str], order: list[str], state: str = "state") -> DataFrame:
    """Windows and runs of each state in each scope, in one pass over the path."""
    w = Window.partitionBy(*scope).orderBy(*order)
    opens = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("long"), F.lit(1).cast("long"))
    return path.withColumn("_opens", opens).groupBy(*scope, state).agg(F.count(F.lit(1)).alias("n"), F.sum("_opens").alias("n_runs"))


def summary(path: DataFrame, scope: list[str], order: list[str], step_sec: float, state: str = "state") -> DataFrame:
    """Occupancy, mean dwell, runs, transitions and their rate of each state and scope, from one pass (ST4).

    A state that is not visited has occupancy 0 and null dwell and runs.
    """
    w = Window.partitionBy(*scope)
    found = on_grid(visits(path, scope, order, state), scope, state, "n")
    n, moves = F.sum("n").over(w), F.sum("n_runs").over(w) - 1
    return found.select(
        *scope, state, (F.col("n") / n).alias("fo"), (F.col("n") / F.col("n_runs") * step_sec).alias("dwell_sec"), "n_runs",
        moves.alias("n_transitions"), n.alias("n_windows"), (moves / (n * step_sec)).alias("rate_hz"),
    )


def occupancy(path: DataFrame, scope: list[str], state: str = "state") -> DataFrame:
    """Share of each state in each scope, zero for states that are not visited (ST1)."""
    counts = on_grid(path.groupBy(*scope, state).count(), scope, state, "count")
    return counts.select(*scope, state, (F.col("count") / F.sum("count").over(Window.partitionBy(*scope))).alias("fo"))


def runs(path: DataFrame, scope: list[str], order: list[str], state: str = "state") -> DataFrame:
    """Maximal runs of one state, with their lengths (ST2)."""
    w = Window.partitionBy(*scope).orderBy(*order)
    changed = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(1))
    return path.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w)).groupBy(*scope, "run", state).agg(F.count(F.lit(1)).alias("length"))


def runs_occupancy(run_table: DataFrame, scope: list[str], state: str = "state") -> DataFrame:
    """``occupancy`` from runs (``scope, run, state, length``) instead of the path."""
    counts = on_grid(run_table.groupBy(*scope, state).agg(F.sum("length").alias("count")), scope, state, "count")
    return counts.select(*scope, state, (F.col("count") / F.sum("count").over(Window.partitionBy(*scope))).alias("fo"))


def runs_matrix(run_table: DataFrame, scope: list[str], state: str = "state") -> DataFrame:
    """``transition_matrix`` from runs: a run stays for all its windows but one, and then goes to the state of the next."""
    w = Window.partitionBy(*scope).orderBy("run")
    cut = run_table.select(F.col(state).alias("i"), F.lead(state).over(w).alias("_next"), "length")
    moves = F.inline(F.array(F.struct(F.col("i").alias("j"), (F.col("length") - 1).alias("n")), F.struct(F.col("_next").alias("j"), F.lit(1).cast("long").alias("n"))))
    counts = cut.select("i", moves).where("j IS NOT NULL AND n > 0").groupBy("i", "j").agg(F.sum("n").alias("n"))
    return counts.select("i", "j", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("i"))).alias("p"))


def global_runs(path: DataFrame, session: str, order: list[str], state: str = "state") -> DataFrame:
    """``state, length`` of the runs of one path made of all sessions in their order: a run may go on in the next (ST8).

    Runs are cut by session; only the first and last of each, two rows a session, are joined across sessions.  Those lie in
    range partitions, each of which learns how the one before it ends and how many runs open before it.
    """
    by = Window.partitionBy(session)
    cut = runs(path, [session], order, state).select(session, "run", state, "length", F.min("run").over(by).alias("_a"), F.max("run").over(by).alias("_b"))
    cut = checkpoint(cut)
    inner = cut.where("run > _a AND run < _b").select(state, "length")
    parts = int(path.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edge = checkpoint(cut.where("run = _a OR run = _b").repartitionByRange(parts, session).withColumn("_part", F.spark_partition_id()))
    ends = edge.groupBy("_part").agg(F.max(F.struct(session, "run", state)).alias("_end"))
    before = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_end"))  # a row a partition
    here = Window.partitionBy("_part").orderBy(session, "run")
    known = edge.join(F.broadcast(before), "_part")
    last = F.coalesce(F.lag(F.struct(session, "run", state)).over(here), F.col("_end"))
    goes_on = (last[session] != F.col(session)) & (last[state] == F.col(state))
    opened = known.withColumn("_new", F.when(goes_on, 0).otherwise(1)).drop("_end")
    total = opened.groupBy("_part").agg(F.sum("_new").alias("_n"))
    base = total.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row a partition
    joined = opened.withColumn("_g", F.sum("_new").over(here)).join(F.broadcast(base), "_part").withColumn("_g", F.col("_g") + F.col("_base"))
    return joined.groupBy("_g", state).agg(F.sum("length").alias("length")).select(state, "length").unionByName(inner)


def dwell(path: DataFrame, scope: list[str], order: list[str], step_sec: float, state: str = "state") -> DataFrame:
    """Mean run length in seconds of each visited state (ST2)."""
    return runs(path, scope, order, state).groupBy(*scope, state).agg((F.avg("length") * step_sec).alias("dwell_sec"), F.count(F.lit(1)).alias("n_runs"))


def transitions(path: DataFrame, scope: list[str], order: list[str], step_sec: float, state: str = "state") -> DataFrame:
    """Number and rate of state changes (ST5, ST19, ST21)."""
    w = Window.partitionBy(*scope).orderBy(*order)
    changed = path.withColumn("_c", (F.lag(state).over(w) != F.col(state)).cast("long"))
    n = F.coalesce(F.sum("_c"), F.lit(0))
    return changed.groupBy(*scope).agg(n.alias("n_transitions"), F.count(F.lit(1)).alias("n_windows"), (n / (F.count(F.lit(1)) * step_sec)).alias("rate_hz"))


def transition_matrix(path: DataFrame, scope: list[str], order: list[str], state: str = "state", diagonal: bool = True) -> DataFrame:
    """Empirical transition counts and row shares (ST15, ST16)."""
    w = Window.partitionBy(*scope).orderBy(*order)
    pairs = path.select(F.col(state).alias("i"), F.lead(state).over(w).alias("j")).where(F.col("j").isNotNull())
    if not diagonal:
        pairs = pairs.where("i != j")
    counts = pairs.groupBy("i", "j").count()
    return counts.select("i", "j", F.col("count").alias("n"), (F.col("count") / F.sum("count").over(Window.partitionBy("i"))).alias("p"))


def row_entropy(matrix: DataFrame) -> DataFrame:
    """Entropy (natural log) of each row of a transition matrix (ST16, ST24)."""
    return matrix.groupBy("i").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def off_diagonal(matrix: DataFrame) -> DataFrame:
    """``i, j, p`` of a matrix ``i, j, n`` without its diagonal, for all pairs of its states; a row of sum 0 is 0 (ST15)."""
    states = matrix.select(F.explode(F.array("i", "j")).alias("s")).agg(F.array_sort(F.collect_set("s")).alias("s"))
    grid = states.select(F.explode("s").alias("i"), "s").select("i", F.explode("s").alias("j"))  # states squared
    moved = grid.join(matrix.where("i <> j"), ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("i"))
    return moved.select("i", "j", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("p"))


def dwell_histogram(run_table: DataFrame, state: str = "state") -> DataFrame:
    """Runs of each state by length, dwell quantiles, and percentages of runs of one window and of over ten (ST17).

    Exact quantiles hold a number a distinct length, of which ``n`` windows have at most ``sqrt(2 n)``.
    """
    n = F.col("length")
    bucket = lambda name, cond: F.sum(cond.cast("long")).alias(name)
    share = lambda name, cond: (100 * F.avg(cond.cast("double"))).alias(name)
    return run_table.groupBy(state).agg(
        bucket("n_1", n == 1), bucket("n_2", n == 2), bucket("n_3_5", n.between(3, 5)), bucket("n_6_10", n.between(6, 10)), bucket("n_over_10", n > 10),
        F.percentile("length", 0.25).alias("p25"), F.percentile("length", 0.75).alias("p75"), F.percentile("length", 0.95).alias("p95"),
        share("pct_1", n == 1), share("pct_over_10", n > 10),
    )


def trial_dwell(path: DataFrame, trial: list[str], order: list[str], step: float, state: str = "state", absent: float | None = None) -> DataFrame:
    """Mean dwell of each state in each trial; ``absent`` stands where a trial does not visit a state (ST18)."""
    found = on_grid(visits(path, trial, order, state), trial, state)
    dwell = F.col("n") / F.col("n_runs") * step
    return found.select(*trial, state, F.coalesce(dwell, F.lit(absent).cast("double")).alias("dwell"), F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"))


def metric_means(values: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of each subject, averaged over its trials (ST20), in long form ``metric, value``."""
    means = values.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])
    return means.unpivot(by, metrics, "metric", "value")


def evoked(path: DataFrame, trial: list[str], position: str, keys: list[list[str]], state: str = "state") -> DataFrame:
    """Share of each state at each position over the trials of modal length, for each set of key columns (EV1).

    A key that a set leaves out is null; a state that no trial shows at a position is 0.
    """
    columns = list(dict.fromkeys(c for k in keys for c in k))
    needed = path.select(*columns, position, state, F.count(F.lit(1)).over(Window.partitionBy(*trial)).alias("_n"))
    known = needed.groupBy("_n", *columns, position, state).agg(F.count(F.lit(1)).alias("_k"))
    known = checkpoint(known)  # a row a length, key, position and state
    modal = known.groupBy("_n").agg((F.sum("_k") / F.col("_n")).alias("count")).orderBy(F.desc("count"), F.desc("_n")).limit(1).select("_n")
    kept = known.join(F.broadcast(modal), "_n")  # one row
    sets = [[*[F.col(c) for c in k], F.col(position), F.col(state)] for k in keys]
    counts = kept.groupingSets(sets, *columns, position, state).agg(F.sum("_k").alias("count"))
    coded = counts.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})
    full = on_grid(coded, [*columns, position], state, "count")
    total = F.sum("count").over(Window.partitionBy(*columns, position))
    return full.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns], position, state, (F.col("count") / total).alias("p"))


def window_times(position: Column, start: float, size: float, step: float, trim: int = 0) -> Column:
    """Middle of a window in the unit of ``start``; positions count from the first window that ``trim`` leaves (EV2)."""
    return F.lit(start) + (position + trim) * F.lit(step) + F.lit(size / 2)


def courses_apart(a: DataFrame, b: DataFrame, position: str, state: str = "state", most: float = 0.02) -> DataFrame:
    """Greatest gap of two evoked courses in each state and whether it is under ``most`` (EV5)."""
    both = a.select(position, state, F.col("p").alias("a")).join(b.select(position, state, F.col("p").alias("b")), [position, state])
    return both.groupBy(state).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("delta")).withColumn("robust", F.col("delta") < most)


def peak(profile: DataFrame, keys: list[str], position: str, state: str = "state") -> DataFrame:
    """First position of the highest share for each key and state (EV3)."""
    w = Window.partitionBy(*keys, state).orderBy(F.desc("p"), position)
    return profile.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
