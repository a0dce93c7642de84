"""Profiles of states, their likeness, soft evoked courses, absorbing sessions and suitability scores.

Feature matrices are in long form ``(session, row, dim, x)``; profiles have a row a state and dimension, so
what is joined with itself is bounded by states and dimensions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesostate.operators.diagnostics import label
from mesostate.operators.matrices import centroids, correlations, standardised
from mesostate.operators.statequality import verdict

SUITABLE = [(0.80, "excellent"), (0.65, "good"), (0.45, "acceptable"), (0.25, "poor")]
PRIOR = {"high": 0.9, "medium": 0.6, "low": 0.3}


def profiles(long: DataFrame, state: str) -> DataFrame:
    """Mean standardised value of each state and dimension (CMP1)."""
    return standardised(long).groupBy(F.col(state).alias("state"), "dim").agg(F.avg("z").alias("z"))


def raw_profiles(long: DataFrame, state: str) -> DataFrame:
    """Mean value of each state and dimension as it is (CMP9)."""
    return centroids(long, state).select(F.col(state).alias("state"), "dim", F.col("m").alias("z"))


def profile_table(profile: DataFrame, columns: DataFrame, share: float = 0.98) -> DataFrame:
    """``state, feature, part, channel, z, limit``: profiles by what their dimensions are, with the colour limit of a feature (CMP5).

    A profile has a row a state and dimension, so the exact limit is of few values.
    """
    named = profile.join(F.broadcast(columns), "dim")  # one row a dimension
    limits = named.groupBy("feature").agg(F.percentile(F.abs("z"), share).alias("limit"))
    return named.join(limits, "feature").select("state", "feature", "part", "channel", "z", "limit")


def contrasted(profile: DataFrame) -> DataFrame:
    """Profiles standardised over their own dimensions; a flat one is 0 (CMP8)."""
    w = Window.partitionBy("state")
    sd = F.stddev_pop("z").over(w)
    return profile.select("state", "dim", F.when(sd < 1e-12, 0.0).otherwise((F.col("z") - F.avg("z").over(w)) / sd).alias("z"))


def likeness(profile: DataFrame, against: DataFrame | None = None) -> DataFrame:
    """Cosine and distance of each ordered pair of different states, or of each state with each of another model (CMP2, CMP3, CMP9, M11)."""
    other = (profile if against is None else against).select(F.col("state").alias("j"), "dim", F.col("z").alias("zj"))
    dot, own, his = F.sum(F.col("z") * F.col("zj")), F.sum(F.col("z") ** 2), F.sum(F.col("zj") ** 2)
    pairs = profile.withColumnRenamed("state", "i").join(other, "dim")
    pairs = (pairs.where("i <> j") if against is None else pairs).groupBy("i", "j")
    return pairs.agg((dot / F.sqrt(own * his)).alias("cosine"), F.sqrt(F.sum((F.col("z") - F.col("zj")) ** 2)).alias("distance"))


def most_alike(pairs: DataFrame) -> DataFrame:
    """The other state of the greatest cosine, the least name first, and the mean cosine to all others (CMP2)."""
    best = F.min(F.struct((-F.round("cosine", 9)).alias("c"), "j"))
    return pairs.groupBy("i").agg(best.alias("b"), F.avg("cosine").alias("mean_cosine")).select("i", F.col("b.j").alias("j"), (-F.col("b.c")).alias("cosine"), "mean_cosine")


def best_matching(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """The column of each row in the one-to-one matching of least total cost, and a bound that no matching can be under.

    Rows, no more than columns, enter one by one along a shortest augmenting path under reduced costs.  The bound is the
    sum of the potentials, which equals the total of an optimal matching.
    """
    n, m = cost.shape
    rows, columns = np.zeros(n), np.zeros(m)  # potentials
    owner = np.full(m, -1)
    for row in range(n):
        far, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, last, reach = row, -1, 0.0
        while True:
            through = reach + cost[at] - rows[at] - columns
            nearer = ~done & (through < far)
            far[nearer], came[nearer] = through[nearer], last
            last = int(np.where(done, np.inf, far).argmin())
            reach, done[last] = far[last], True
            if owner[last] < 0:
                break
            at = owner[last]
        inner = done & (np.arange(m) != last)
        rows[owner[inner]] += reach - far[inner]
        columns[inner] -= reach - far[inner]
        rows[row] += reach
        while last >= 0:
            before = came[last]
            owner[last] = row if before < 0 else owner[before]
            last = before
    found = np.zeros(n, int)
    found[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return found, float(rows.sum() + columns[owner >= 0].sum())


def assignment(pairs: DataFrame) -> DataFrame:
    """``i, j, cosine, matched``: the one-to-one matching of greatest total cosine, and the nearest for states left over (J9, CMP4).

    ``pairs`` is ``likeness`` of two models; its cells, states times states, reach the driver.
    """
    cells = pairs.orderBy("i", "j").toPandas()
    value = cells.pivot(index="i", columns="j", values="cosine").fillna(-1e9)
    left, right, v = value.index.tolist(), value.columns.tolist(), value.to_numpy()
    few, turned = (v, False) if len(left) <= len(right) else (v.T, True)
    best = best_matching(-few)[0] if few.size else ()
    found = {(int(b), a) if turned else (a, int(b)) for a, b in enumerate(best)}
    rest = set(range(len(left))) - {a for a, _ in found}
    rows = [(left[a], right[b], float(v[a, b]), True) for a, b in sorted(found)] + [(left[a], right[int(v[a].argmax())], float(v[a].max()), False) for a in sorted(rest)]
    kinds = dict(pairs.dtypes)
    return pairs.sparkSession.createDataFrame(rows, f"i {kinds['i']}, j {kinds['j']}, cosine double, matched boolean")


def mixture_posterior(long: DataFrame, means: DataFrame, keys: list[str], spread: float = 1.0) -> DataFrame:
    """``keys, p``: probability of each state (in order of its name) given all dimensions of a row, by equal Gaussians about ``means(state, dim, m)``."""
    each = long.join(F.broadcast(means), "dim").groupBy(*keys, "state").agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("q"))  # states by dimensions
    near = F.array_sort(F.collect_list(F.struct("state", "q")))
    weight = F.transform("w", lambda s: F.exp((F.array_min(F.transform("w", lambda v: v["q"])) - s["q"]) / (2 * spread * spread)))
    rows = each.groupBy(*keys).agg(near.alias("w")).select(*keys, weight.alias("w"))
    return rows.select(*keys, F.transform("w", lambda v: v / F.aggregate("w", F.lit(0.0), lambda t, u: t + u)).alias("p"))


def soft_evoked(posterior: DataFrame, session: str, position: str, p: str = "p") -> DataFrame:
    """Mean over sessions of their mean posterior at each position, and its standard error (EV4)."""
    by = posterior.select(session, position, F.posexplode(p).alias("state", "v")).groupBy(session, position, "state").agg(F.avg("v").alias("v"))
    return by.groupBy(position, "state").agg(F.avg("v").alias("p"), (F.stddev_pop("v") / F.sqrt(F.count("v"))).alias("sem"))


def standard_error(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of a value and its population standard error (STAT2)."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"))


def difference(fo: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Mean occupancies of two groups by state and what their gap is called (STAT3, EV5)."""
    by = fo.groupBy("state").pivot(group, [a, b]).agg(F.avg("fo"))
    delta = F.abs(F.col(a) - F.col(b))
    name = F.when(delta < 0.02, "robusto").when(delta < 0.05, "leve").otherwise("significativo")
    return by.select("state", F.col(a).alias("fo_a"), F.col(b).alias("fo_b"), delta.alias("delta"), name.alias("effect"))


def centroid_distance(long: DataFrame, centroids: DataFrame, session: str) -> DataFrame:
    """Mean and deviation of each session's distances to each centroid, and how far the mean is from those of the
    other sessions, in their deviations (ABS2)."""
    each = long.join(centroids, "dim").groupBy(session, "row", "state").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)).alias("d"))
    by = each.groupBy(session, "state").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"))
    w = Window.partitionBy("state")
    n, s1, s2 = F.count("mean").over(w) - 1, F.sum("mean").over(w) - F.col("mean"), F.sum(F.col("mean") ** 2).over(w) - F.col("mean") ** 2
    rest = F.when(n > 0, s1 / n)
    return by.withColumn("rest", rest).withColumn("z", (F.col("mean") - rest) / (F.sqrt(F.greatest(F.lit(0.0), s2 / n - rest**2)) + 1e-9))


def onset(posterior: DataFrame, session: str, order: str, p: Column, over: float = 0.95) -> DataFrame:
    """Where a session's posterior first passes ``over`` and how often it does, in percent of its windows (ABS3)."""
    placed = posterior.select(session, (F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1).alias("t"), p.alias("p"))
    high, n = F.col("p") > over, F.count(F.lit(1))
    return placed.groupBy(session).agg((100 * F.min(F.when(high, F.col("t"))) / n).alias("onset"), (100 * F.count_if(high) / n).alias("above"))


def window_sensitivity(small: DataFrame, large: DataFrame) -> DataFrame:
    """Correlation and mean gap of one feature over two window lengths, on the rows that both have (DG13)."""
    both = small.join(large.select("row", "dim", F.col("x").alias("y")), ["row", "dim"])
    found = both.agg(F.corr("x", "y").alias("r"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("gap"))
    return found.withColumn("label", F.when(F.col("r") > 0.9, "robust").when(F.col("r") > 0.7, "moderate").otherwise("sensitive"))


def effective_rank(rows: DataFrame, x: str = "x") -> DataFrame:
    """Effective rank, dominance and label of the correlation matrix of arrays (DG17 to DG20); only its cells reach the driver."""
    cells = correlations(rows, x).toPandas()
    size = int(cells["j"].max()) + 1 if len(cells) else 1
    full = np.eye(size)
    full[cells["i"], cells["j"]] = full[cells["j"], cells["i"]] = cells["r"].fillna(0.0)
    share = np.clip(np.linalg.eigvalsh(full), 1e-12, None)
    share /= share.sum()
    rank, upper = float(np.exp(-(share * np.log(share)).sum())), np.abs(full[np.triu_indices(size, 1)])
    name = "low_redundancy" if rank / size > 0.85 else "moderate_redundancy" if rank / size > 0.60 else "high_redundancy"
    row = (rank, float(share.max()), float(upper.mean()) if size > 1 else 0.0, float(upper.max()) if size > 1 else 0.0, name)
    return rows.sparkSession.createDataFrame([row], "rank double, dominance double, mean_r double, max_r double, redundancy string")


def suitability(scores: DataFrame, prior: str | Column | None = None) -> DataFrame:
    """Score, label and warnings from ``gauss, lag1, noise, fingerprint`` (DG25, DG26).

    ``prior`` is what the metadata say of all features, or a column of it; unknown ones count as between.
    """
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    temporal = clip((F.col("lag1") + 1) / 2) * F.exp(-F.col("noise"))
    steady = clip(1 - F.col("fingerprint"))
    said = prior if isinstance(prior, Column) else F.lit(prior)
    weight = F.coalesce(*[F.when(said == name, value) for name, value in PRIOR.items()], F.lit(0.5))
    out = scores.withColumn("temporal", temporal).withColumn("suitability", clip(0.40 * F.col("gauss") + 0.35 * F.col("temporal") + 0.15 * steady + 0.10 * weight))
    warned = [F.when(F.col("gauss") < 0.40, "gauss"), F.when(F.col("temporal") < 0.35, "noise"), F.when(steady < 0.35, "identity")]
    return out.withColumn("label", label(F.col("suitability"), SUITABLE, "very_poor")).withColumn("warnings", F.concat_ws(",", *warned))


def experiment_summary(occupancy: DataFrame, dwell: DataFrame, confidence: DataFrame, over: float = 0.95) -> DataFrame:
    """One row of an experiment: least and greatest occupancy, longest dwell, confidence, absorbing sessions, score, verdict (SNK13).

    ``occupancy`` has ``session, state, fo``; ``dwell`` has ``state, dwell``; ``confidence`` has one row and column.
    """
    by = occupancy.groupBy("state").agg(F.avg("fo").alias("fo"))
    shares = by.agg(F.min("fo").alias("fo_min"), F.max("fo").alias("fo_max"), F.count(F.lit(1)).alias("k"))
    sessions = occupancy.groupBy("session").agg(F.max("fo").alias("m")).agg(F.count(F.lit(1)).alias("n_sessions"), F.count_if(F.col("m") > over).alias("n_absorbing"))
    longest = dwell.agg(F.max("dwell").alias("dwell_max"))
    one = shares.crossJoin(sessions).crossJoin(longest).crossJoin(confidence.toDF("confidence"))  # a row each
    met = lambda c: c.cast("int")
    score = met(F.col("fo_min") >= 0.10) + met(F.col("dwell_max") <= 2000) + met(F.col("fo_max") - F.col("fo_min") <= 0.30) + met(F.col("confidence") >= 0.60)
    return one.withColumn("score", score).withColumn("verdict", verdict(F.col("score"))).withColumn("pct_absorbing", 100 * F.col("n_absorbing") / F.col("n_sessions"))


def leaderboard(summaries: DataFrame) -> DataFrame:
    """Experiments with their rank: most points, then fewest states, then name (CMP6)."""
    w = Window.orderBy(F.desc("score"), "k", "experiment")  # a row an experiment
    return summaries.withColumn("place", F.row_number().over(w))


def method_occupancy(fo: DataFrame, by: list[str]) -> DataFrame:
    """Mean occupancy of each method, group and state, and its standard error of the sample (CMP7)."""
    return fo.groupBy(*by).agg(F.avg("fo").alias("mean"), (F.stddev_samp("fo") / F.sqrt(F.count("fo"))).alias("sem"), F.count("fo").alias("n"))


def absorber_profile(long: DataFrame, absorbers: DataFrame, session: str, kind: str) -> DataFrame:
    """Mean standardised value of each kind of feature in each absorbing session, and in all others, whose session is null (ABS1)."""
    z = standardised(long)
    own = z.join(absorbers.select(session).distinct(), session, "left_semi").groupBy(session, kind).agg(F.avg("z").alias("z"))
    rest = z.join(absorbers.select(session).distinct(), session, "left_anti").groupBy(kind).agg(F.avg("z").alias("z"))
    return own.unionByName(rest.withColumn(session, F.lit(None).cast(dict(long.dtypes)[session])))


def absorber_table(absorbers: DataFrame, transitions: DataFrame, distances: DataFrame, posterior: DataFrame, session: str, over: float = 0.95) -> DataFrame:
    """Absorbing sessions with occupancy, distance, share of sure windows and transitions; greatest occupancy first (ABS4).

    ``posterior`` has ``session, state, p`` a row for each window and state.
    """
    sure = posterior.groupBy(session, "state").agg((100 * F.avg((F.col("p") > over).cast("double"))).alias("above"))
    both = absorbers.join(transitions.select(session, "n_transitions"), session).join(distances.select(session, "state", F.col("z").alias("z_distance")), [session, "state"], "left")
    return both.join(sure, [session, "state"], "left").orderBy(F.desc("fo"), session, "state")


def most_balanced(occupancy: DataFrame, session: str, n: int, absorbing_over: float = 0.95) -> DataFrame:
    """The ``n`` sessions of least spread of occupancy, absorbing ones left out, with how many states they visit (a top-k report)."""
    by = occupancy.groupBy(session).agg(F.stddev_pop("fo").alias("spread"), F.max("fo").alias("most"), F.count_if(F.col("fo") > 0).alias("n_states"))
    return by.where(F.col("most") <= absorbing_over).orderBy(F.round("spread", 9), session).limit(n)
