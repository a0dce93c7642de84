"""Features, names, models, reports, readers and writers by hand and against other forms."""

import json
import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mesostate.operators import comparison, diagnostics, features, kernels, labels, matrices, models, signals, states, statequality
from mesostate.sources import readers, writers

# features ---------------------------------------------------------------------------------------------------------


def test_registry():
    r = features.Registry()
    f = r.register(features.Feature("one", 1))
    assert r.get("one") is f and "one" in r and len(r) == 1 and r.is_registered("one") and r.names() == ["one"]
    with pytest.raises(ValueError):
        r.register(features.Feature("one", 1))
    with pytest.raises(ValueError):
        r.register(features.Feature("", 1))
    with pytest.raises(KeyError):
        r.get("two")


def test_descriptions_of_features():
    names = lambda d: [f.name for f in features.REGISTRY.resolve(d)]
    assert names({}) == [] and names(None) == []
    assert names({"use_hjorth": True, "use_alpha": True, "use_beta": False}) == ["alpha_envelope", "hjorth_mobility", "hjorth_complexity"]
    assert names({"active": ["temporal_entropy", "alpha_envelope"]}) == ["temporal_entropy", "alpha_envelope"]
    with pytest.raises(ValueError):
        names({"active": ["temporal_entropy", "temporal_entropy"]})
    with pytest.raises(KeyError):
        names({"active": ["nothing"]})


def test_metadata(spark):
    rows = features.REGISTRY.metadata(spark).collect()
    assert [r["name"] for r in rows] == sorted(features.REGISTRY.names()) and {r["name"]: r["width"] for r in rows}["hemispheric_asymmetry"] == 21
    known = {r["name"]: (r["suitability"], r["gaussian_friendly"], r["scaling"]) for r in rows}
    assert known == {
        "alpha_envelope": ("medium", False, "log_zscore"), "theta_envelope": ("high", True, "zscore"), "beta_envelope": ("medium", True, "log_zscore"),
        "hjorth_mobility": ("high", True, "zscore"), "hjorth_complexity": ("medium", True, "zscore"), "temporal_entropy": ("medium", False, "robust_zscore"),
        "relative_power": ("high", False, "zscore"), "band_ratios": ("high", True, "zscore"), "hemispheric_asymmetry": ("medium", True, "zscore"),
    }
    assert {r["name"] for r in rows if not r["per_channel"]} == {"hemispheric_asymmetry"}
    with pytest.raises(ValueError):
        features.Registry().register(features.Feature("two words", 1))


def test_columns_of_a_vector():
    chosen = [features.REGISTRY.get(n) for n in ("alpha_envelope", "relative_power", "hemispheric_asymmetry")]
    columns = features.columns_of(chosen, features.CHANNELS)
    assert len(columns) == 19 + 57 + 21 and columns[0] == (0, "alpha_envelope", "0", "Fp1") and columns[19][1:] == ("relative_power", "0", "Fp1") and columns[-1][1:] == ("hemispheric_asymmetry", "beta", "F7-F8")
    assert len(features.columns_of(chosen, features.CHANNELS, raw_bands=False)) == 78


def test_assembly_by_hand(spark):
    rng = np.random.default_rng(2)
    x = {c: rng.normal(size=60) for c in features.CHANNELS}
    windows = spark.createDataFrame([(1, 1, 0, c, v.tolist()) for c, v in x.items()], "session int, trial int, win_idx int, channel string, samples array<double>")
    chosen = [features.REGISTRY.get(n) for n in ("hjorth_mobility", "alpha_envelope", "band_ratios", "hemispheric_asymmetry")]
    env = {}
    for band, (lo, hi) in features.BANDS.items():
        b, a = kernels.band_pass(250.0, lo, hi)
        env[band] = {c: float(np.log1p(kernels.magnitude(kernels.both_ways(b, a, v[None])).mean())) for c, v in x.items()}
    mobility = [float(np.sqrt(np.diff(v).var() / v.var())) for v in x.values()]
    alpha = [env["alpha"][c] for c in features.CHANNELS]
    log = lambda band, c: math.log(abs(env[band][c]) + 1e-10)
    ratios = [log(p, c) - log(q, c) for p, q in (("theta", "alpha"), ("alpha", "beta"), ("theta", "beta")) for c in features.CHANNELS]
    sides = [(env[b][r] - env[b][left]) / (env[b][r] + env[b][left] + 1e-10) for b in features.BANDS for left, r in features.PAIRS]
    (row,) = features.assemble(windows, chosen).collect()
    assert np.allclose(row["x"], mobility + alpha + ratios + sides)
    (less,) = features.assemble(windows, chosen, raw_bands=False).collect()
    assert np.allclose(less["x"], mobility + ratios + sides)
    with pytest.raises(PySparkException):
        features.assemble(windows.where("channel <> 'Cz'"), chosen).collect()
    with pytest.raises(ValueError):
        features.assemble(windows, [])


def test_older_theta_and_missing_bands(spark):
    x = np.sin(2 * np.pi * 6 * np.arange(200) / 250)
    rows = spark.createDataFrame([(x.tolist(),)], "samples array<double>")
    new, old = (features.with_envelopes(rows, 250.0, log).first()["env"]["theta"] for log in ("log1p", "floor"))
    b, a = kernels.band_pass(250.0, 4.0, 8.0)
    for found, pad in ((math.expm1(new), None), (math.exp(old) - 1e-12, kernels.ringing(b, a))):
        assert math.isclose(found, float(kernels.magnitude(kernels.both_ways(b, a, x[None], pad)).mean()), rel_tol=1e-9)
    env = spark.createDataFrame([(1.0, 2.0, 3.0)], "alpha double, theta double, beta double").select(F.struct("*").alias("env"))
    share = env.select(*features.relative_power(F.col("env"), ("alpha", "beta"))).first()
    assert np.allclose(share, [0.25, 0.0, 0.75])


def test_numbers_that_are_not_finite_count_as_zero(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (None,), (2.5,)], "x double")
    assert [r[0] for r in rows.select(features.finite(F.col("x"))).collect()] == [0, 0, 0, 0, 2.5]


def test_short_epochs_and_trials_raise(spark):
    short = spark.createDataFrame([(1, "a", [1.0, 2.0])], "id int, c string, samples array<double>")
    for bad in (signals.sliding_windows(short, 3, 1), signals.embed(short, 2), signals.embed_channels(short, ["id"], "c", 2)):
        with pytest.raises(PySparkException):
            bad.collect()
    uneven = spark.createDataFrame([(1, "a", [1.0, 2.0, 3.0]), (1, "b", [1.0, 2.0])], "id int, c string, samples array<double>")
    with pytest.raises(PySparkException):
        signals.embed_channels(uneven, ["id"], "c", 1).collect()


def test_windows_that_do_not_overlap_and_lags_of_channels(spark):
    epoch = spark.createDataFrame([(1, "b", [10.0, 11.0, 12.0, 13.0, 14.0]), (1, "a", [0.0, 1.0, 2.0, 3.0, 4.0])], "id int, c string, samples array<double>")
    assert sorted(r["samples"] for r in signals.sliding_windows(epoch.where("c = 'a'"), 2, 2).collect()) == [[0, 1], [2, 3]]
    rows = signals.embed_channels(epoch, ["id"], "c", 1, 2).orderBy("t").collect()
    assert [r["x"] for r in rows] == [[2, 12, 0, 10], [3, 13, 1, 11], [4, 14, 2, 12]]


# states -----------------------------------------------------------------------------------------------------------


def test_global_runs_cross_sessions(spark):
    path = [(1, 0, "a"), (1, 1, "a"), (2, 0, "a"), (3, 0, "a"), (3, 1, "b"), (3, 2, "b"), (3, 3, "a"), (4, 0, "b"), (5, 0, "b"), (5, 1, "a")]
    runs = states.global_runs(spark.createDataFrame(path, "s int, t int, state string"), "s", ["t"]).collect()
    assert sorted((r["state"], r["length"]) for r in runs) == [("a", 1), ("a", 1), ("a", 4), ("b", 2), ("b", 2)]


def test_absent_states_and_empty_rows(spark):
    path = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, "b"), (2, 1, "b")], "s int, t int, state string")
    null = {(r["s"], r["state"]): r["dwell"] for r in states.trial_dwell(path, ["s"], ["t"], 10.0).collect()}
    zero = {(r["s"], r["state"]): r["dwell"] for r in states.trial_dwell(path, ["s"], ["t"], 10.0, absent=0.0).collect()}
    assert null == {(1, "a"): 20.0, (1, "b"): None, (2, "a"): None, (2, "b"): 20.0} and zero[1, "b"] == 0.0
    moved = states.off_diagonal(states.transition_matrix(path, ["s"], ["t"])).collect()
    assert {(r["i"], r["j"], r["p"]) for r in moved} == {(i, j, 0.0) for i in "ab" for j in "ab"}
    assert states.summary(path.limit(0), ["s"], ["t"], 0.1).count() == 0


# diagnostics ------------------------------------------------------------------------------------------------------


def test_kpss_of_a_level_and_a_trend(spark):
    rng = np.random.default_rng(4)
    level, trend = rng.normal(size=200), rng.normal(size=200) + np.arange(200) * 0.1
    long = spark.createDataFrame([(1, d, k, float(v)) for d, x in enumerate((level, trend)) for k, v in enumerate(x)], "s int, dim int, row int, x double")
    found = {r["dim"]: r for r in diagnostics.kpss(long, ["s"], "row").collect()}
    for d, x in enumerate((level, trend)):
        e, n = x - x.mean(), 200
        lags = int(4 * (n / 100) ** 0.25)
        variance = (e @ e + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
        assert math.isclose(found[d]["kpss"], (np.cumsum(e) ** 2).sum() / n**2 / variance, rel_tol=1e-9)
    assert found[0]["p"] > 0.05 and found[1]["p"] == 0.01


def test_error_function(spark):
    xs = [-6.0, -2.5, -0.3, 0.0, 0.7, 1.9, 2.999, 3.001, 5.0]
    found = spark.createDataFrame([(x,) for x in xs], "x double").select("x", matrices.erf(F.col("x")).alias("e")).collect()
    assert all(abs(r["e"] - math.erf(r["x"])) < 1e-9 for r in found)


def test_mann_whitney_by_pairs(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 12, 30), rng.integers(2, 14, 25)
    rows = spark.createDataFrame([(True, int(v)) for v in a] + [(False, int(v)) for v in b], "side boolean, v int")
    found = matrices.mann_whitney(rows, "side", "v").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    ties = sum(n**3 - n for n in np.unique(np.concatenate([a, b]), return_counts=True)[1])
    sd = math.sqrt(30 * 25 / 12 * (56 - ties / (55 * 54)))
    z = max(abs(u - 375) - 0.5, 0) / sd
    assert found["u"] == u and math.isclose(found["z"], z) and math.isclose(found["p"], math.erfc(z / math.sqrt(2)), rel_tol=1e-6)


def test_constant_dimension_has_no_correlation(spark):
    rows = spark.createDataFrame([([1.0, float(k), 2.0 * k],) for k in range(5)], "x array<double>")
    found = {(r["i"], r["j"]): r["r"] for r in matrices.correlations(rows).collect()}
    assert found[0, 1] is None and math.isclose(found[1, 2], 1.0)
    assert [r["grade"] for r in matrices.redundant(matrices.correlations(rows)).collect()] == ["extreme"]


# models -----------------------------------------------------------------------------------------------------------


def _two_clouds(spark):
    rng = np.random.default_rng(8)
    data = []
    for s in range(5):
        state = 0
        for t in range(60):
            state = state if rng.random() < 0.9 else 1 - state
            y = rng.normal(size=2)
            data.append((s, t, [float(y[0]), float(0.9 * y[0] + 0.3 * y[1] + 3 * state)]))
    return spark.createDataFrame(data, "s int, t int, x array<double>"), data


@pytest.mark.parametrize("kind", ["full", "tied"])
def test_covariances_against_direct_likelihoods(spark, kind):
    rows, data = _two_clouds(spark)
    model = models.fit_hmm(rows, ["s"], "t", 2, n_iter=25, covariance=kind)
    obs = np.array([r[2] for r in data[:7]])
    dens = model.log_density(obs)
    for k in range(2):
        cov = model.var[k] if kind == "full" else model.var
        gap = obs - model.mean[k]
        want = -0.5 * (np.einsum("ti,ij,tj->t", gap, np.linalg.inv(cov), gap) + np.log(np.linalg.det(2 * np.pi * cov)))
        assert np.allclose(dens[:, k], want)
    assert all(b >= a - 1e-6 for a, b in zip(model.history, model.history[1:], strict=False))
    diag = models.fit_hmm(rows, ["s"], "t", 2, n_iter=25)
    assert model.history[-1] > diag.history[-1] and model.var.shape == ((2, 2, 2) if kind == "full" else (2, 2))


def test_one_step_of_full_covariances(spark):
    """One expectation and maximisation by hand."""
    rows, data = _two_clouds(spark)
    first, second = (models.fit_hmm(rows, ["s"], "t", 2, n_iter=n, tol=-1e9, covariance="full") for n in (1, 2))
    x = np.array([r[2] for r in data]).reshape(5, 60, 2)
    post = np.concatenate([first.forward_backward(o)[1] for o in x])
    flat, k = x.reshape(-1, 2), 1
    mean = post[:, k] @ flat / post[:, k].sum()
    cov = np.einsum("t,ti,tj->ij", post[:, k], flat - mean, flat - mean) / post[:, k].sum()
    assert np.allclose(second.mean[k], mean) and np.allclose(second.var[k], cov, atol=1e-8)


def test_record_lengths_and_criterion(spark):
    model = models.Hmm(np.ones(1), np.ones((1, 1)), np.zeros((1, 1)), np.ones((1, 1)), (-5.0, -3.5), True)
    r = model.record(spark).first()
    assert (r["converged"], r["n_iter"], r["delta_final"], r["log_likelihoods"]) == (True, 2, 1.5, [-5.0, -3.5])
    rows = spark.createDataFrame([(1,), (1,), (2,)], "s int")
    stated = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "s int, n int")
    assert {(x["s"], x["found"], x["stated"]) for x in models.check_lengths(rows, stated, "s").collect()} == {(2, 1, 2), (3, None, 1)}
    fits = spark.createDataFrame([(3, 4, 100, c, -50.0) for c in ("diag", "full", "tied")], "k int, d int, n long, covariance string, log_likelihood double")
    for row in models.bic_table(fits).collect():
        assert math.isclose(row["bic"], models.bic(-50.0, 3, 4, 100, row["covariance"])) and row["n_parameters"] == models.free_parameters(3, 4, row["covariance"])


def test_explained_curve(spark):
    rows = spark.createDataFrame([([float(k), float(k % 3), 1.0],) for k in range(20)], "x array<double>")
    curve = models.principal_components(rows, 0.5).curve(spark).orderBy("component").collect()
    assert len(curve) == 3 and math.isclose(curve[-1]["cumulative"], 1.0)


def test_assignment_against_all_matchings(spark):
    rng = np.random.default_rng(1)
    value = rng.normal(size=(3, 5))
    pairs = spark.createDataFrame([(f"a{i}", j, float(value[i, j])) for i in range(3) for j in range(5)], "i string, j int, cosine double")
    best = max(permutations(range(5), 3), key=lambda p: sum(value[i, j] for i, j in enumerate(p)))
    assert {(r["i"], r["j"]) for r in comparison.assignment(pairs).collect()} == {(f"a{i}", j) for i, j in enumerate(best)}
    turned = comparison.assignment(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "cosine")).collect()
    assert {(r["j"], r["i"]) for r in turned if r["matched"]} == {(f"a{i}", j) for i, j in enumerate(best)} and sum(not r["matched"] for r in turned) == 2
    assert comparison.assignment(pairs.limit(0)).count() == 0


# names and files --------------------------------------------------------------------------------------------------


def test_names_by_hand(spark):
    rows = spark.createDataFrame([("abcSINGO",), ("abcNOGO_sin_contexto",), ("josé_NG",), ("plain",)], "n string")
    found = [tuple(r) for r in rows.select(F.inline(F.array(labels.parse_name(F.col("n"), ["ABC"])))).collect()]
    assert found == [("ABCSIN", "ADULTO", "GO"), ("ABC", "ADULTO", "NOGO"), ("JOSÉ_", "ADOLESCENTE", "NOGO"), ("PLAIN", "ADOLESCENTE", "GO")]
    assert [r[0] for r in labels.without_prefixes(rows, "n", ["Jose", "ÀBC"]).collect()] == ["plain"]
    assert labels.without_prefixes(rows, "n", []).count() == 4
    assert rows.select(labels.experiment_id(F.lit("task"), F.lit("hmm"), F.lit(4), F.lit(90), F.lit(None), F.lit("car"))).first()[0] == "task_hmm_K4_PCA90_CAR"
    assert rows.select(labels.experiment_id(F.lit("task"), F.lit("hmm"), F.lit(4), F.lit(90), F.lit(3), F.lit("car"), F.lit(250))).first()[0] == "task_hmm_K4_PCA90_L3_CAR_DS250"


def test_descriptions_in_yaml(tmp_path):
    (tmp_path / "a.yaml").write_text("preprocessing:\n  eeg_limit: 500e-6\n  names: [a, 1e3]\n")
    assert readers.description(str(tmp_path / "a.yaml")) == {"preprocessing": {"eeg_limit": 0.0005, "names": ["a", 1000.0]}}
    (tmp_path / "b.yaml").write_text("")
    assert readers.description(str(tmp_path / "b.yaml")) == {}


@pytest.mark.parametrize("kind", ["diag", "full", "tied"])
def test_models_written_and_read(spark, tmp_path, kind):
    rows, _ = _two_clouds(spark)
    model = models.fit_hmm(rows, ["s"], "t", 2, n_iter=3, covariance=kind)
    writers.model(model, str(tmp_path / "m"), spark)
    again = writers.read_model(spark, str(tmp_path / "m"))
    obs = np.array([[0.3, 1.0], [0.1, -2.0]])
    assert np.allclose(again.log_density(obs), model.log_density(obs)) and np.allclose(again.step, model.step) and again.history == model.history and again.converged == model.converged
    fitted = models.principal_components(rows)
    writers.components(fitted, str(tmp_path / "c"), spark)
    assert spark.read.parquet(str(tmp_path / "c/explained")).count() == 2


def test_manifests_reports_and_limits(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "id int, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    (row,) = writers.file_manifest(spark, str(tmp_path / "t")).collect()
    assert row["file"].endswith(".parquet") and len(row["md5"]) == 32 and row["n_bytes"] > 0
    text = [r["report"] for r in writers.markdown(df, F.concat(F.lit("row "), F.col("id").cast("string")), {"values": ["v"]}).orderBy("id").collect()]
    assert text == ["# row 1\n\n## values\n\n- **v**: 0.5000", "# row 2\n\n## values\n\n- **v**: -"]
    assert json.loads(writers.as_json(df.where("id = 1")).first()["json"]) == {"id": 1, "v": 0.5}
    (tmp_path / "s.json").write_text('{\n  "score": 3,\n  "verdict": "ACEPTABLE"\n}')
    assert readers.manifest(spark, str(tmp_path / "s.json")).first()["score"] == 3
    monkeypatch.setattr(writers, "MOST_ROWS", 1)
    with pytest.raises(ValueError):
        writers.single_file(df, str(tmp_path / "csv"))


def test_health_of_an_experiment(spark):
    table = spark.createDataFrame([("a", 0.05, 0.98, 100.0), ("b", 0.95, 0.5, 200.0)], "state string, fo double, self_trans double, dwell_analytic double")
    checks = statequality.health(table, F.lit(0.9), F.lit(5), F.lit(10), F.lit(5))
    assert {(r["item"], r["grade"]) for r in checks.collect()} == {("dwell a", "critical"), ("dwell b", "ok"), ("fo balance", "critical"), ("confidence", "ok"), ("absorbing", "critical"), ("condition balance", "warning")}
    assert statequality.fit_for_report(checks).first()["verdict"] == "correct first"


def test_the_entry_without_the_corpus_part(monkeypatch):
    import importlib

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("mesostate.llm"):
            raise ModuleNotFoundError(f"No module named {name}", name="mesostate.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert "state_dwell" in entry.queries() and not any(n.startswith("op") for n in entry.queries())

    def broken(name, *a):
        raise ModuleNotFoundError("No module named mesostate.llm.typo", name="mesostate.llm.typo")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
