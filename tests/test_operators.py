"""Operators against DuckDB on the small tables, and by hand."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mesostate.operators import comparison, kernels, models, signals, states
from mesostate.plans import assembled, catalogue, comparing, extended

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.QUERIES | extended.QUERIES | comparing.QUERIES | assembled.QUERIES, catalogue.SQL | extended.SQL | comparing.SQL | assembled.SQL


def plain(rows):
    return sorted(repr(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "customer", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, found.select([f"`{c}`" for c in columns]).collect())) == plain(con.sql(f"SELECT {quoted} FROM ({SQL[name]}) q").fetchall())


def test_runs_by_hand(spark):
    path = spark.createDataFrame([(1, k, s) for k, s in enumerate([0, 0, 1, 1, 1, 0])], "session int, t int, state int")
    assert sorted(r["length"] for r in states.runs(path, ["session"], ["t"]).collect()) == [1, 2, 3]
    dwell = {r["state"]: r["dwell_sec"] for r in states.dwell(path, ["session"], ["t"], 0.1).collect()}
    assert math.isclose(dwell[0], 0.15) and math.isclose(dwell[1], 0.3)
    assert states.transitions(path, ["session"], ["t"], 0.1).first()["n_transitions"] == 2


def test_windows_and_embedding(spark):
    epoch = spark.createDataFrame([(1, [float(v) for v in range(325)])], "id int, samples array<double>")
    assert signals.sliding_windows(epoch, 75, 25).count() == 11
    assert signals.sliding_windows(epoch, 75, 25, 1).count() == 9
    with pytest.raises(PySparkException):
        signals.sliding_windows(epoch, 75, 25, 6).collect()
    short = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0, 4.0])], "id int, samples array<double>")
    assert [r["x"] for r in signals.embed(short, 2).orderBy("t").collect()] == [[2, 1, 0], [3, 2, 1], [4, 3, 2]]


def test_degenerate_features(spark):
    rows = spark.createDataFrame([([1.0] * 10,), ([float(v) for v in range(10)],)], "samples array<double>")
    found = rows.select(signals.hjorth(F.col("samples")).alias("h"), signals.histogram_entropy(F.col("samples")).alias("e")).collect()
    assert found[0]["h"]["mobility"] == 0 and found[0]["e"] == 0
    assert found[1]["h"]["mobility"] < 1e-6 and math.isclose(found[1]["e"], math.log2(10))


def test_components_agree_with_a_full_decomposition(spark):
    x = np.random.default_rng(3).normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, x array<double>")
    fitted = models.principal_components(rows, 0.9)
    sizes = np.linalg.svd(x - x.mean(axis=0))[1] ** 2
    assert np.allclose(fitted.ratio, (sizes / sizes.sum())[: len(fitted.ratio)]) and fitted.ratio.sum() > 0.9
    found = np.array([r["pc"] for r in fitted.transform(rows).orderBy("id").collect()])
    assert np.allclose(found, (x - x.mean(axis=0)) @ fitted.loadings.T)


def test_hmm_against_all_paths(spark):
    rng = np.random.default_rng(5)
    model = models.Hmm(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[0.0], [2.0]]), np.ones((2, 1)))
    obs = rng.normal(size=(6, 1)) + 1
    dens, weight = model.log_density(obs), {}
    for code in range(2**6):
        p = [(code >> t) & 1 for t in range(6)]
        weight[tuple(p)] = np.log(model.start[p[0]]) + sum(np.log(model.step[a, b]) for a, b in zip(p, p[1:], strict=False)) + sum(dens[t, s] for t, s in enumerate(p))
    assert tuple(model.viterbi(obs)) == max(weight, key=weight.get)
    ll, posterior, counts = model.forward_backward(obs)
    assert np.isclose(ll, np.logaddexp.reduce(list(weight.values())))
    assert np.isclose(posterior[2, 1], sum(np.exp(w - ll) for p, w in weight.items() if p[2])) and np.isclose(counts.sum(), 5)


def test_hmm_fit_finds_two_levels(spark):
    rng = np.random.default_rng(9)
    data = [(s, t, [float(rng.normal() * 0.3 + (4 if (t // 10) % 2 else 0))]) for s in range(6) for t in range(40)]
    rows = spark.createDataFrame(data, "s int, t int, x array<double>")
    model = models.fit_hmm(rows, ["s"], "t", 2, n_iter=12)
    assert np.allclose(sorted(model.mean.ravel()), [0, 4], atol=0.2)
    assert all(b >= a - 1e-6 for a, b in zip(model.history, model.history[1:], strict=False))
    found = model.decode(rows, ["s"], "t").where("s = 0").orderBy("t").collect()
    assert [(r["t"] // 10) % 2 for r in found] == [r["state"] if model.mean[1] > model.mean[0] else 1 - r["state"] for r in found]


def test_registered_hmm_is_fitted_to_the_end(spark, monkeypatch):
    from mesostate.plans import extended

    fit, seen = models.fit_hmm, []
    monkeypatch.setattr(models, "fit_hmm", lambda *a, **b: seen.append(fit(*a, **b)) or seen[-1])
    rows = extended.QUERIES["m5_hmm_states"](spark, "/root/testdata/sf0.001")
    (model,) = seen
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert model.mean.shape == (3, 64) and (model.converged or len(model.history) == 500)
    assert not model.converged or model.history[-1] - model.history[-2] < 1e-3


def test_band_pass_response():
    b, a = kernels.band_pass(250.0, 8.0, 13.0)
    at = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 250)) / np.polyval(a, np.exp(2j * np.pi * f / 250)))
    w = lambda f: np.tan(np.pi * f / 250)
    closed = lambda f: (1 + ((w(f) ** 2 - w(8) * w(13)) / (w(f) * (w(13) - w(8)))) ** 8) ** -0.5
    for f in (2.0, 5.0, 8.0, 10.2, 13.0, 30.0, 90.0):
        assert np.isclose(at(f), closed(f), rtol=1e-5, atol=1e-9)


def test_kernels_on_a_sinusoid(spark):
    t = np.arange(750) / 250
    wave = np.sin(2 * np.pi * 10 * t)
    rows = spark.createDataFrame([(1, wave.tolist()), (2, None), (3, (wave + np.sin(2 * np.pi * 80 * t)).tolist())], "id int, samples array<double>")
    bands = {k: kernels.envelope("samples", 250.0, *b).alias(k) for k, b in {"theta": (4, 8), "alpha": (8, 13), "beta": (13, 30)}.items()}
    found = {r["id"]: r for r in rows.select("id", *bands.values()).collect()}
    assert abs(found[1]["alpha"] - np.log(2)) < 0.05 and found[1]["alpha"] > 4 * found[1]["theta"] and found[1]["alpha"] > 4 * found[1]["beta"]
    assert found[2]["alpha"] is None or np.isnan(found[2]["alpha"])
    low = {r["id"]: r[1] for r in rows.select("id", kernels.low_pass("samples", 250.0, 30.0)).collect()}
    assert low[2] is None and np.abs(np.array(low[3])[60:-60] - wave[60:-60]).max() < 0.02
    half = {r["id"]: r[1] for r in rows.select("id", kernels.resample("samples", 250.0, 125.0)).collect()}
    assert np.allclose(half[1], wave[::2], atol=1e-9)
    psd = {r["id"]: r[1] for r in rows.select("id", kernels.welch("samples", 250.0)).collect()}
    assert abs(max(psd[1], key=lambda r: r["p"])["f"] - 10) < 1 and abs(sum(r["p"] for r in psd[1]) * 250 / 256 - 0.5) < 0.02


def test_short_signal_raises():
    with pytest.raises(ValueError):
        kernels.both_ways(*kernels.band_pass(250.0, 8.0, 13.0), np.zeros((1, 20)))


def test_effective_rank(spark):
    x = np.random.default_rng(0).normal(size=(50, 4))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    rows = spark.createDataFrame([(r, x[r].tolist()) for r in range(50)], "row int, x array<double>")
    corr = np.corrcoef(x.T)
    share = np.linalg.eigvalsh(corr) / 4
    found = comparison.effective_rank(rows).first()
    assert math.isclose(found["rank"], np.exp(-(share * np.log(share)).sum()), rel_tol=1e-9) and math.isclose(found["dominance"], share.max(), rel_tol=1e-9)
    assert math.isclose(found["max_r"], np.abs(corr[0, 1]), rel_tol=1e-9)
