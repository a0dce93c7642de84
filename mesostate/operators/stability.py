"""How far states hold between halves of the subjects, and tests by relabelling subjects."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesostate.operators import comparison, models, orderstats
from mesostate.storage import checkpoint


def uniform(*of: Column | str) -> Column:
    """A number in 0..1 by a hash alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *of)), 1, 12), 16, 10).cast("double") / float(2**48)


def halves(rows: DataFrame, subject: str, seed: int = 42, into: str = "half") -> DataFrame:
    """``rows`` with the half, 0 or 1, of their subject by a hash."""
    return rows.withColumn(into, (uniform(F.lit(str(seed)), F.col(subject).cast("string")) < 0.5).cast("int"))


def _matched(profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state of the second half of each of the first, and the cosines of the pairs."""
    a, b = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), models.TINY) for p in profiles)
    cosine = a @ b.T
    to, _ = comparison.best_matching(-cosine)
    return to, cosine[np.arange(len(to)), to]


def split_half(rows: DataFrame, subject: str, sequence: list[str], order: str, k: int, x: str = "x", seed: int = 42, replicates: int = 200, restarts: int = 4, n_iter: int = 500) -> DataFrame:
    """``state, other, cosine, low, high, share``: states of one half of the subjects with the state of the other half that each is matched with.

    Each half has a fit of its own, from cluster centres; states are matched for the greatest total cosine of
    their mean values, less the mean of all rows.  ``low`` and ``high`` are the 2.5th and 97.5th percentiles of the cosine over
    ``replicates`` in which subjects count as often as a hash of theirs says (Poisson of mean 1), all made in one job, and ``share``
    how often the replicate matches the same states.  Subjects, replicates and states reach the driver as ``replicates * states * dimensions`` numbers.
    """
    halved = checkpoint(halves(rows.select(subject, *[c for c in sequence if c != subject], order, x), subject, seed))
    parts = []
    for half in (0, 1):
        own = halved.where(F.col("half") == half)
        fitted = models.fit_hmm(own, sequence, order, k, x=x, start="clusters", restarts=restarts, seed=seed, n_iter=n_iter)
        parts.append(fitted.decode(own, sequence, order, x).drop("posterior").withColumn("half", F.lit(half)))
    decoded = parts[0].unionByName(parts[1]).join(halved.drop("half"), [*sequence, order])
    n = F.count(F.lit(1)).cast("double")
    sums = decoded.select(subject, "half", "state", F.posexplode(x).alias("dim", "v")).groupBy(subject, "half", "state", "dim").agg(n.alias("n"), F.sum("v").alias("s"))
    subjects = sums.groupBy(subject).agg(F.collect_list(F.struct("half", "state", "dim", "n", "s")).alias("g"))  # states by dimensions
    # made once and spread over all cores, as little of it stands for many replicates
    subjects = checkpoint(subjects.repartition(rows.sparkSession.sparkContext.defaultParallelism, subject))
    u, e = F.col("u"), float(np.exp(-1))
    below = np.cumsum([e / float(np.prod(range(1, j + 1))) for j in range(12)]).tolist()
    poisson = F.aggregate(F.lit(below).cast("array<double>"), F.lit(0), lambda a, p: a + (u >= p).cast("int"))
    drawn = subjects.select("g", subject, F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("b")).withColumn("u", uniform(F.lit(f"{seed}:boot"), F.col("b").cast("string"), F.col(subject).cast("string")))
    weighted = drawn.select("b", F.when(F.col("b") == 0, 1).otherwise(poisson).alias("w"), "g").where("w > 0").select("b", "w", F.inline("g"))  # replicate 0 has every subject once
    totals = weighted.groupBy("b", "half", "state", "dim").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("s")).alias("s")).toPandas()
    dims = int(totals["dim"].max()) + 1
    count, total = np.zeros((replicates + 1, 2, k)), np.zeros((replicates + 1, 2, k, dims))
    at = tuple(totals[c].to_numpy() for c in ("b", "half", "state", "dim"))
    total[at], count[at[:3]] = totals["s"], totals["n"]
    mean = total.sum(axis=2) / np.maximum(count.sum(axis=2), 1)[..., None]
    profiles = np.where(count[..., None] > 0, total / np.maximum(count, 1)[..., None] - mean[:, :, None], 0)
    to, cosine = _matched(profiles[0])
    again = [_matched(p) for p in profiles[1:]]
    own = [np.array([c[s] if t[s] == to[s] else np.nan for t, c in again]) for s in range(k)]
    out = [(s, int(to[s]), float(cosine[s]), *[float(q) if len(v := o[~np.isnan(o)]) else None for q in (np.nanpercentile(o, [2.5, 97.5]) if (~np.isnan(o)).any() else (0, 0))], float((~np.isnan(o)).mean())) for s, o in enumerate(own)]
    return rows.sparkSession.createDataFrame(out, "state int, other int, cosine double, low double, high double, share double")


def relabelled(subjects: DataFrame, subject: str, side: str, replicates: int, seed: int = 42, most: int = 5000) -> tuple[DataFrame, bool]:
    """``b, subject, side``: the true labels (``b`` 0) and relabellings with as many subjects on either side, and whether these are all there are.

    With at most ``most`` ways to choose them, and ``20 most`` labels in all of them, all are made, each once; otherwise those subjects are on the first side whose
    hash is among the least, up to the rank that the threshold of the replicate has.
    """
    known = checkpoint(subjects.select(subject, F.col(side).cast("boolean").alias("side")).distinct())
    n, first = known.agg(F.count(F.lit(1)), F.count_if("side")).first()
    spark = subjects.sparkSession
    if n and comb(n, first) <= most and n * comb(n, first) <= 20 * most:
        names = [r[0] for r in known.orderBy(subject).collect()]  # few, as there are few ways
        ways = [(b + 1, s, k in chosen) for b, chosen in enumerate(map(set, combinations(range(n), first))) for k, s in enumerate(names)]
        ways = spark.createDataFrame(ways, f"b int, `{subject}` {known.schema[subject].dataType.simpleString()}, side boolean")
        return ways.unionByName(known.select(F.lit(0).alias("b"), subject, "side")), True
    hashed = checkpoint(known.select(subject, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b")).withColumn("u", uniform(F.lit(str(seed)), F.col("b").cast("string"), F.col(subject).cast("string"))))
    ranks = spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("b"), F.lit(int(first) - 1).cast("long").alias("rank"))
    bounds = orderstats.order_statistics(hashed, ["b"], "u", ranks).select("b", F.col("value").alias("bound"))
    made = hashed.join(F.broadcast(bounds), "b").select("b", subject, (F.col("u") <= F.col("bound")).alias("side"))  # a row a replicate
    return made.unionByName(known.select(F.lit(0).alias("b"), subject, "side")), False


def relabelling_test(values: DataFrame, subject: str, side: str, items: list[str], value: str, replicates: int = 999, seed: int = 42, most: int = 5000) -> DataFrame:
    """``items, effect, p``: the gap of the means of two sides of subjects for each item, and how often relabelled subjects have one as large.

    ``values`` has at most a row a subject and item; a subject without one does not count for it.  All replicates are
    one grouping.  With all relabellings ``p`` is their share, the true one among them; with drawn ones the true one is added.
    """
    labels, all_ways = relabelled(values, subject, side, replicates, seed, most)
    each = values.select(subject, *items, F.col(value).cast("double").alias("_v")).join(labels, subject).groupBy("b", *items)
    gap = each.agg((F.avg(F.when(F.col("side"), F.col("_v"))) - F.avg(F.when(~F.col("side"), F.col("_v")))).alias("gap"))
    gap = checkpoint(gap)
    true = gap.where("b = 0 AND gap IS NOT NULL").select(*items, F.col("gap").alias("effect"))
    as_large = F.count_if(F.abs("gap") >= F.abs("effect") - 1e-12)
    n = F.count("gap")
    return gap.where("b > 0").join(true, items).groupBy(*items, "effect").agg((as_large / n if all_ways else (as_large + 1) / (n + 1)).alias("p"))


def interaction(values: DataFrame, subject: str, group: str, condition: str, conditions: tuple[str, str], items: list[str], value: str, groups: tuple[str, str], **how) -> DataFrame:
    """``items, effect, p``: condition by group.  The effect is the gap between conditions within a subject, in the first group less that in the second.

    Subjects without a value in both conditions do not count.  Groups are relabelled between subjects.
    """
    a, b = (F.avg(F.when(F.col(condition) == c, F.col(value))) for c in conditions)
    gaps = values.where(F.col(group).isin(*groups)).groupBy(subject, group, *items).agg((a - b).alias("_gap")).where("_gap IS NOT NULL")
    return relabelling_test(gaps.withColumn("_side", F.col(group) == groups[0]), subject, "_side", items, "_gap", **how)


def transition_shares(path: DataFrame, subject: str, scope: list[str], order: list[str], state: str = "state") -> DataFrame:
    """``subject, i, j, p``: share of the moves out of a state that go to each other one, by subject; 0 for moves that only others make."""
    w = Window.partitionBy(*scope).orderBy(*order)
    moves = path.select(subject, F.col(state).alias("i"), F.lead(state).over(w).alias("j")).where("j IS NOT NULL AND i != j")
    counts = moves.groupBy(subject, "i", "j").agg(F.count(F.lit(1)).alias("n"))
    left = counts.groupBy(subject, "i").agg(F.sum("n").alias("total"))
    pairs = counts.select("i", "j").distinct()
    return left.join(F.broadcast(pairs), "i").join(counts, [subject, "i", "j"], "left").select(subject, "i", "j", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("p"))  # pairs of states


def step_up(tests: DataFrame, p: str = "p", into: str = "q") -> DataFrame:
    """``tests`` with ``q``, the least rate of false discoveries at which a test passes: ``p`` times tests over its rank, and no more than that of greater ones.

    Ranks and least values come from range partitions of the distinct probabilities.
    """
    from mesostate.operators.matrices import running_before

    counts = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_before(counts, "_p", "_n", "_before")
    m = tests.where(F.col(p).isNotNull()).count()
    parts = int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = ranked.select("_p", (F.col("_p") * m / (F.col("_before") + F.col("_n"))).alias("_raw"))
    ranged = checkpoint(raw.repartitionByRange(parts, "_p").withColumn("_part", F.spark_partition_id()))
    ahead = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    later = ranged.groupBy("_part").agg(F.min("_raw").alias("_m")).select("_part", F.min("_m").over(ahead).alias("_later"))  # a row a partition
    here = Window.partitionBy("_part").orderBy(F.desc("_p"))
    least = ranged.join(F.broadcast(later), "_part").select("_p", F.least(F.min("_raw").over(here), F.coalesce("_later", F.lit(1.0)), F.lit(1.0)).alias(into))
    return tests.join(least, tests[p] == least["_p"], "left").drop("_p")
