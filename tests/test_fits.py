"""Starts and batches of fits, assignments, order statistics and lags, against exhaustive or plain forms."""

from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesostate.operators import clustering, comparison, lags, matrices, models, orderstats


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def blobs(seed=0, n=60, offset=0.0):
    """Five blobs that no line has in its order."""
    r = np.random.default_rng(seed)
    places = np.array([[0, 0], [6, 0], [0, 6], [6, 6], [3, 13]]) + offset
    return places, np.concatenate([p + 0.4 * r.normal(size=(n, 2)) for p in places])[r.permutation(5 * n)]


def sequences(spark, x, length=30):
    return spark.createDataFrame([(k // length, k % length, [float(v) for v in row]) for k, row in enumerate(x)], "s int, t int, x array<double>").repartition(3)


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_centres_are_the_blobs(spark, offset):
    places, x = blobs(offset=offset)
    for found in clustering.k_means(sequences(spark, x), 5, [1, 2, 3]):
        near = np.sqrt(clustering.squared_distances(places, found.points).min(axis=1))
        assert near.max() < 0.3
        assert found.cost == pytest.approx(clustering.squared_distances(x, found.points).min(axis=1).sum(), rel=1e-4 if offset else 1e-9)


def test_centres_of_few_distinct_rows(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)] * 5 + [([3.0, 4.0],)] * 2, "x array<double>")
    found = clustering.k_means(rows, 3, [7])[0]
    assert sorted(found.points.tolist()) == [[1.0, 2.0], [3.0, 4.0]] and found.cost == 0
    assert [r["cluster"] for r in clustering.assigned(rows, np.array([[1.0, 2.0], [3.0, 4.0]])).orderBy("x").collect()] == [0] * 5 + [1] * 2
    with pytest.raises(ValueError):
        clustering.k_means(rows.limit(0), 3)


def test_centres_read_their_rows_twice_however_many_passes_they_take(spark):
    _, x = blobs()
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = sequences(spark, x).select("x").mapInArrow(counted, "x array<double>")
    assert max(c.passes for c in clustering.k_means(rows, 5, [1, 2])) > 2 and read.value == 2 * len(x)  # moments, and packing


def test_copies_take_no_draws_from_other_rows(spark):
    values = [[float(k), float(k * k)] for k in range(12)] * 20
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 12)
    try:
        packed = clustering._packed(spark.createDataFrame([(v,) for v in values], "x array<double>").coalesce(1), len(values), np.zeros(2), "x")
        drawn = clustering._drawn(packed, [None, np.array([[0.0, 0.0]])], 5, [3, 4], 2)
    finally:
        spark.conf.set(batch, before)
    assert [len(set(map(tuple, d))) for d in drawn] == [5, 5] and [0.0, 0.0] not in drawn[1].tolist()


def test_clusters_start_beats_the_axis_and_is_as_good_as_any(spark):
    places, x = blobs(n=24)
    rows = sequences(spark, x, 24)
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True)
    pool = [places[k] for k in range(5)] + [mean]
    every = [np.stack([pool[k] for k in pick]) for pick in product(range(6), repeat=3) if len(set(pick)) == 3 and list(pick) == sorted(pick)]
    every = [np.concatenate([e, np.stack([pool[k] for k in rest])]) for e in every for rest in ([0, 3], [1, 2], [4, 5])]
    best = max(m.history[-1] for m in models.fit_many(rows, ["s"], "t", [models.starting(e, cov) for e in every], n_iter=60))
    axis = models.fit_hmm(rows, ["s"], "t", 5, n_iter=60)
    clusters = models.fit_hmm(rows, ["s"], "t", 5, n_iter=60, start="clusters", restarts=3)
    assert clusters.history[-1] >= best - 0.05
    assert clusters.history[-1] > axis.history[-1] + 5


def test_many_fits_are_single_fits_in_as_many_jobs_as_one(spark):
    _, x = blobs(3, 30)
    rows = sequences(spark, x, 25)
    cov = np.cov(x.T, bias=True)
    starts = [models.starting(x[[1, 50, 90][:k]], cov, kind) for k, kind in ((2, "diag"), (3, "full"), (3, "tied"), (2, "tied"))]
    together, n_together = jobs(spark, "together", lambda: models.fit_many(rows, ["s"], "t", starts, n_iter=12))
    for start, fit in zip(starts, together, strict=True):
        (alone,), n_alone = jobs(spark, f"alone{start.covariance}{len(start.mean)}", lambda start=start: models.fit_many(rows, ["s"], "t", [start], n_iter=12))
        assert np.allclose(alone.history, fit.history, rtol=1e-9) and np.allclose(alone.mean, fit.mean) and np.allclose(alone.var, fit.var)
        assert alone.converged == fit.converged
        assert n_together <= n_alone + 4 or len(alone.history) < 12


def test_sequences_side_by_side_are_sequences_alone():
    r = np.random.default_rng(5)
    obs = [r.normal(size=(n, 2)) for n in (7, 1, 12, 12, 3)]
    model = models.Hmm(np.array([0.2, 0.5, 0.3]), r.dirichlet(np.ones(3), 3), r.normal(size=(3, 2)), np.ones((3, 2)))
    total, counts, posts = 0.0, np.zeros((3, 3)), []
    for o in obs:
        ll, post, c = model.forward_backward(o)
        # all paths
        like = sum(
            model.start[p[0]] * np.prod([model.step[a, b] for a, b in zip(p, p[1:], strict=False)]) * np.prod([np.exp(model.log_density(o)[t, s]) for t, s in enumerate(p)])
            for p in product(range(3), repeat=len(o))
        ) if len(o) < 8 else None
        assert like is None or ll == pytest.approx(np.log(like))
        total, counts = total + ll, counts + c
        posts.append(post.sum(axis=0))
    groups = list(models._side_by_side(obs))
    assert len(groups) == 1
    ll, post, c = model.smoothed(*groups[0])
    assert ll == pytest.approx(total) and np.allclose(c, counts) and np.allclose(post.sum(axis=0), np.sum(posts, axis=0))


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_offsets_cost_no_precision(spark, offset):
    r = np.random.default_rng(1)
    base = r.normal(size=(500, 3)) @ np.array([[1, 0.8, 0], [0, 0.4, 0], [0, 0, 1]])
    moved = base + offset
    centred = moved - moved.mean(axis=0)
    rows = spark.createDataFrame([(v.tolist(),) for v in moved], "x array<double>").repartition(5)
    found = {(q["i"], q["j"]): q["r"] for q in matrices.correlations(rows).collect()}
    assert all(abs(found[i, j] - np.corrcoef(centred.T)[i, j]) < 1e-6 for i, j in found)
    n, mean, moments = models.co_moments(rows)
    assert n == 500 and np.allclose(moments, centred.T @ centred, rtol=1e-6, atol=1e-5)
    assert np.allclose(models.principal_components(rows).ratio, np.sort(np.linalg.eigvalsh(np.cov(centred.T)))[::-1][: len(models.principal_components(rows).ratio)] / np.trace(np.cov(centred.T)), rtol=1e-6)
    flat = spark.createDataFrame([([offset + 5.1, float(k)],) for k in range(50)], "x array<double>").repartition(3)
    assert matrices.correlations(flat).first()["r"] is None
    if offset:
        a = models.fit_hmm(rows.select(F.lit(1).alias("s"), F.monotonically_increasing_id().alias("t"), "x"), ["s"], "t", 2, n_iter=5, covariance="full")
        assert np.allclose(a.mean.mean(axis=0), moved.mean(axis=0), atol=2)


@pytest.mark.parametrize("shape", [(1, 1), (1, 4), (4, 4), (5, 7), (8, 8)])
def test_matchings_against_all(shape):
    for seed in range(20):
        r = np.random.default_rng(seed)
        cost = r.normal(size=shape) if seed % 2 else r.integers(0, 3, shape).astype(float)
        if shape == (8, 8) and seed > 3:
            continue
        found, bound = comparison.best_matching(cost)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(shape[1]), shape[0]))
        assert cost[range(shape[0]), found].sum() == pytest.approx(best) and len(set(found.tolist())) == shape[0]
        assert bound == pytest.approx(best)


@pytest.mark.parametrize("shape", [(200, 200), (150, 200)])
def test_large_matchings_meet_their_bound(shape):
    cost = np.random.default_rng(7).normal(size=shape)
    found, bound = comparison.best_matching(cost)
    assert cost[range(shape[0]), found].sum() == pytest.approx(bound) and len(set(found.tolist())) == shape[0]


def test_quantiles_of_hard_groups(spark, monkeypatch):
    monkeypatch.setattr(orderstats, "FEW", 8)
    monkeypatch.setattr(orderstats, "BINS", 16)
    r = np.random.default_rng(2)
    groups = {
        "normal": r.normal(size=900), "ties": r.integers(0, 3, 700).astype(float), "one": np.array([3.5]), "two": np.array([-1.0, 4.0]), "flat": np.full(300, 2.5),
        "wide": np.sign(r.normal(size=500)) * 10.0 ** r.uniform(-300, 300, 500), "tiny": np.concatenate([5e-324 * r.integers(0, 50, 400), [1e308, -1e308]]), "close": 1e9 + r.integers(0, 100, 600) * 1e-6,
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("normal", float("nan")), ("normal", float("inf")), ("ties", None), (None, 1.0)]
    at = {"q0": 0.0, "q01": 0.01, "q25": 0.25, "q5": 0.5, "q99": 0.99, "q1": 1.0}
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    found = {r["g"]: r for r in orderstats.quantiles(df, ["g"], "x", at).collect()}
    for g, x in groups.items():
        s = np.sort(x)
        for name, q in at.items():
            pos = (len(s) - 1) * q
            a, b = int(np.floor(pos)), int(np.ceil(pos))
            want = s[a] if a == b or s[a] == s[b] else (b - pos) * s[a] + (pos - a) * s[b]
            assert found[g][name] == want, (g, name)


def test_quantiles_are_those_of_percentile_on_many_values(spark):
    df = spark.range(3_000_000).select((F.hash("id") % 5).alias("g"), (F.randn(3) * 1000).alias("x"))
    df = df.where("g = 0 OR g % 7 = 3").withColumn("x", F.round("x", 7) + F.hash("x") / 1e12).select(F.lit(1).alias("g"), "x")
    found = orderstats.quantiles(df, ["g"], "x", {"a": 0.01, "b": 0.5, "c": 0.99}).first()
    want = df.agg(F.percentile("x", [0.01, 0.5, 0.99]).alias("p")).first()["p"]
    assert [found["a"], found["b"], found["c"]] == want


def plain_kpss(x):
    n = len(x)
    e = x - x.mean()
    product = lambda k: float(e[k:] @ e[: n - k])
    few = int(n ** (2 / 9) + 1e-9)
    s0, s1 = product(0) / n + 2 * sum(product(k) for k in range(1, few + 1)) / n, 2 * sum(k * product(k) for k in range(1, few + 1)) / n
    most = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    variance = (product(0) + 2 * sum((1 - k / (most + 1)) * product(k) for k in range(1, most + 1))) / n
    return most, float((np.cumsum(e) ** 2).sum() / n**2 / variance)


@pytest.mark.parametrize("chunk", [16_384, 37])
def test_automatic_lags(spark, monkeypatch, chunk):
    monkeypatch.setattr(lags, "CHUNK", chunk)
    r = np.random.default_rng(4)
    series = {1: r.normal(size=500), 2: np.cumsum(r.normal(size=300)), 3: np.full(40, 7.0), 4: np.array([1.0, 5.0]), 5: 1e6 + r.normal(size=1000) + np.sin(np.arange(1000) / 30)}
    long = spark.createDataFrame([("s", k, d, float(v)) for d, x in series.items() for k, v in enumerate(x)], "s string, row int, dim int, x double").repartition(5)
    found = {r["dim"]: r for r in lags.kpss_auto(long, ["s"], "row").collect()}
    assert all(found[d][c] is None for d in (3, 4) for c in ("lags", "kpss", "p")) and set(found) == set(series)
    for d in (1, 2, 5):
        most, value = plain_kpss(series[d])
        assert found[d]["lags"] == most and found[d]["kpss"] == pytest.approx(value, rel=1e-6)
        assert found[d]["p"] == pytest.approx(np.interp(value, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]), rel=1e-4)
    assert found[2]["p"] == 0.01
    assert lags.kpss_auto(long.limit(0), ["s"], "row").count() == 0


def test_a_series_in_many_tasks(spark):
    """One series of two million steps: no partition holds it whole, and the figures are those of the plain form."""
    n = 2_000_000
    x = np.sin(np.arange(n) / 1000.0) + (np.arange(n) * 7919 % 1013) / 1013
    long = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("row"), F.lit(0).alias("dim"), (F.sin(F.col("id") / 1000.0) + (F.col("id") * 7919 % 1013) / 1013).alias("x"))
    found = lags.kpss_auto(long, ["s"], "row").first()
    most, value = plain_kpss(x)
    assert found["lags"] == most and found["kpss"] == pytest.approx(value, rel=1e-6)
