"""How much work steps make, and that the lighter forms of them give what plain ones do."""

import time

import numpy as np
import pandas as pd

from mesostate.operators import kernels, labels, models


def test_names_meet_few_parts(spark):
    """Parts of a name that begin as no subject does are not looked for (before: all parts as long as some subject, some 80 of these names)."""
    subjects = [("BUI12", "GO"), ("BUI123", "GO"), ("bui7", "NOGO"), ("Éa", "GO"), ("Z", "GO"), ("", "GO"), (None, "GO"), ("MAC1234567", "GO"), ("XX", None)]
    files = [("BUI123_go_MAC_features", "GO"), ("bui12_BUI12", "GO"), ("aéaéa", "GO"), ("pizza", "GO"), ("BUI7", "GO"), ("BUI7", "NOGO"), ("BUI", "GO"), ("", "GO"), (None, "GO"), ("XX", None), ("MAC1234567z", "GO"), ("MAC123456", "GO")]
    known = spark.createDataFrame(subjects, "subject string, condition string")
    given = spark.createDataFrame(files, "file string, condition string")
    found = {(r["file"], r["condition"]): (r["subject"], r["reason"]) for r in labels.match_names(given, known).collect()}
    for f, c in files:
        hits = [s for s, k in subjects if f is not None and s and k == c is not None and s.upper() in f.upper()]
        want = (hits[0], None) if len(hits) == 1 else (None, "several matches" if hits else "no match")
        assert found[f, c] == want, (f, c)
    assert labels._parts(given, known, "file", "subject", "condition").where("file = 'BUI123_go_MAC_features'").count() == 4  # BUI1, BUI12, BUI123, MAC_featur


def some_model(kind="diag", k=3, d=2, seed=0):
    r = np.random.default_rng(seed)
    spread = {"diag": r.uniform(0.5, 2, (k, d)), "full": np.stack([a @ a.T + np.eye(d) for a in r.normal(size=(k, d, d))]), "tied": np.array([[2.0, 0.7], [0.7, 1.0]])}[kind]
    return models.Hmm(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.normal(size=(k, d)), spread, covariance=kind)


def uneven(spark, n=300, seed=4):
    """Sequences of 1 to 12 rows, one of 700, and one whose name is null."""
    r = np.random.default_rng(seed)
    lengths = [700, *r.integers(1, 13, n).tolist()]
    obs = {(None if s == 1 else f"s{s}", s % 3): r.normal(size=(m, 2)) for s, m in enumerate(lengths)}
    rows = [(a, b, t, v.tolist()) for (a, b), x in obs.items() for t, v in enumerate(x)]
    return obs, spark.createDataFrame([rows[k] for k in r.permutation(len(rows))], "a string, b int, t int, x array<double>").repartition(3)


def test_many_short_sequences_are_laid_side_by_side_in_linear_time():
    """Before, each sequence that came to a group had the lengths of the whole group added up again: 40,000 of them took over 20 s."""
    began = time.perf_counter()
    groups = list(models._side_by_side([np.zeros((3, 1))] * 40_000))
    assert time.perf_counter() - began < 5 and sum(len(obs) for obs, _ in groups) == 120_000


def test_groups_hold_each_row_once(monkeypatch):
    monkeypatch.setattr(models, "SIDE_BY_SIDE", 40)
    lengths = np.array([3, 50, 1, 7, 7, 1, 2, 12])
    groups = list(models._arranged(lengths, 2))
    assert sorted(np.concatenate([at for at, _ in groups]).tolist()) == list(range(lengths.sum())) and len(groups) > 2
    starts = np.cumsum(lengths) - lengths
    for at, active in groups:
        ends = np.concatenate([[0], np.cumsum(active)])
        first = at[: active[0]]
        assert set(first) <= set(starts)
        for t, n in enumerate(active):
            assert at[ends[t] : ends[t + 1]].tolist() == (first[:n] + t).tolist()


def test_sequences_are_decoded_side_by_side(spark, monkeypatch):
    """States and posteriors of many sequences in one task are those of each alone; before, each was a group of its own."""
    obs, rows = uneven(spark)
    for kind in ("diag", "full", "tied"):
        model = some_model(kind)
        found = {}
        for r in model.decode(rows, ["a", "b"], "t").collect():
            found.setdefault((r["a"], r["b"]), []).append((r["t"], r["state"], r["posterior"]))
        assert set(found) == set(obs)
        for key, x in obs.items():
            got = sorted(found[key])
            assert [g[0] for g in got] == list(range(len(x))) and [g[1] for g in got] == model.viterbi(x).tolist()
            assert np.allclose([g[2] for g in got], model.forward_backward(x)[1])
    assert "FlatMapGroups" not in model.decode(rows, ["a", "b"], "t")._jdf.queryExecution().toString()


def test_a_step_of_a_fit_is_one_stage(spark):
    _, rows = uneven(spark)
    start, context = models.starting(np.array([[0.0, 1.0], [1.0, 0.0]]), np.eye(2)), spark.sparkContext
    stages = {}
    for n in (2, 7):
        context.setJobGroup(f"steps{n}", "steps")
        models.fit_many(rows, ["a", "b"], "t", [start], n_iter=n, tol=-1.0)
        tracker = context.statusTracker()
        stages[n] = sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"steps{n}"))
    context._jsc.clearJobGroup()
    assert stages[7] - stages[2] == 5


def test_kernels_work_on_few_signals_at_once(monkeypatch):
    """Before, a matrix had all signals of a length of a batch, and a result that was cut out of a wider array kept that array."""
    monkeypatch.setattr(kernels, "AT_ONCE", 100)
    r, most, wide = np.random.default_rng(6), [], []

    def work(x):
        most.append(x.size)
        wide.append(np.hstack([x, x, x]))
        return wide[-1][:, : x.shape[1]]

    signals = pd.Series([None if k % 7 == 0 else r.normal(size=(5, 30, 0, 400)[k % 4]) for k in range(200)])
    found = kernels._by_length(signals, work)
    assert max(most) == 400 and sorted(set(most))[-2] <= 100
    for got, given in zip(found, signals, strict=True):
        assert (got is None) == (given is None) and (given is None or (np.array_equal(got, given) and not any(np.shares_memory(got, w) for w in wide)))
