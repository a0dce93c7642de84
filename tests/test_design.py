"""Stability of states, tests by relabelling, sample entropy and recordings in text, against plain or enumerated forms."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesostate.operators import complexity, kernels, matrices, stability, states
from mesostate.sources import recordings, writers


def plain_alike(x, m, r):
    n = len(x) - m
    found = longer = 0
    for i in range(max(n, 0)):
        for j in range(i + 1, n):
            if np.abs(x[i : i + m] - x[j : j + m]).max() <= r:
                found += 1
                longer += bool(abs(x[i + m] - x[j + m]) <= r)
    return found, longer


@pytest.mark.parametrize("m", [1, 2, 3])
def test_alike_stretches_are_those_of_all_pairs(m):
    rng = np.random.default_rng(m)
    signals = [rng.normal(size=150), np.sin(np.arange(120) / 3), np.round(rng.normal(size=100), 1), np.zeros(30), np.arange(40.0), rng.normal(size=m + 1), rng.normal(size=2), 1e9 + rng.normal(size=90)]
    for x in signals:
        for r in (0.0, 0.1, 0.2 * float(x.std()), 3.0):
            assert complexity.alike(x, m, r) == plain_alike(x, m, r), (len(x), r)


def test_long_signals_are_not_compared_in_all_pairs(monkeypatch):
    seen = []
    real = np.repeat
    monkeypatch.setattr(complexity.np, "repeat", lambda a, n: seen.append(int(np.sum(n))) or real(a, n))
    x = np.random.default_rng(0).normal(size=10_000)
    found, longer = complexity.alike(x, 2, 0.2 * x.std())
    assert 0 < longer < found
    assert sum(seen[::2]) < 0.05 * len(x) ** 2  # candidates


def test_entropy_of_signals(spark):
    rng = np.random.default_rng(1)
    signals = [rng.normal(size=200).tolist(), np.sin(np.arange(200) / 5).tolist(), [1.0] * 50, [1.0, 2.0], None]
    df = spark.createDataFrame(list(enumerate(signals)), "id int, s array<double>")
    found = [r["e"] for r in df.select("id", complexity.sample_entropy(F.col("s")).alias("e")).orderBy("id").collect()]
    a, b = (plain_alike(np.array(s), 2, 0.2 * np.std(s)) for s in signals[:2])
    assert found[0] == pytest.approx(-np.log(a[1] / a[0])) and found[1] == pytest.approx(-np.log(b[1] / b[0])) and found[0] > found[1]
    assert found[2] == 0 and found[3] is None and found[4] is None


def simulated(spark, n_subjects=16, n=60, seed=0):
    r = np.random.default_rng(seed)
    means = np.array([[0, 0, 4], [5, 0, 0], [0, 5, -4]], float)
    rows = []
    for s in range(n_subjects):
        state = 0
        for t in range(n):
            state = state if r.random() < 0.85 else int(r.integers(3))
            rows.append((s, t, [float(v) for v in means[state] + r.normal(size=3)]))
    return spark.createDataFrame(rows, "subject int, t int, x array<double>").repartition(4)


def test_states_of_both_halves_are_the_same(spark):
    found = stability.split_half(simulated(spark), "subject", ["subject"], "t", 3, replicates=40).collect()
    assert sorted(r["other"] for r in found) == [0, 1, 2]
    assert all(r["cosine"] > 0.95 and 0.7 < r["low"] <= r["high"] <= 1 + 1e-9 and r["share"] == 1 for r in found)


def test_halves_by_hash(spark):
    df = spark.range(1000).select(F.col("id").alias("subject"))
    a, b = (stability.halves(d, "subject").orderBy("subject").collect() for d in (df.repartition(3), df.repartition(7)))
    assert a == b and 430 < sum(r["half"] for r in a) < 570


def gap(v, side):
    return v[side].mean() - v[~side].mean()


def test_p_is_that_of_all_relabellings(spark):
    r = np.random.default_rng(3)
    v = {"a": r.normal(size=9) + np.array([1.2] * 4 + [0] * 5), "b": r.normal(size=9)}
    side = np.array([True] * 4 + [False] * 5)
    rows = [(k, bool(side[k]), item, float(x[k])) for item, x in v.items() for k in range(9)]
    df = spark.createDataFrame(rows, "s int, side boolean, item string, v double").repartition(3)
    want = {}
    for item, x in v.items():
        gaps = [gap(x, np.isin(np.arange(9), c)) for c in combinations(range(9), 4)]
        want[item] = (gap(x, side), np.mean([abs(g) >= abs(gap(x, side)) - 1e-12 for g in gaps]))
    found = {r["item"]: (r["effect"], r["p"]) for r in stability.relabelling_test(df, "s", "side", ["item"], "v").collect()}
    assert all(found[i] == pytest.approx(want[i]) for i in want)
    drawn = {r["item"]: r["p"] for r in stability.relabelling_test(df, "s", "side", ["item"], "v", replicates=1500, most=0).collect()}
    assert all(abs(drawn[i] - want[i][1]) < 0.05 for i in want)


def test_one_side_or_none(spark):
    df = spark.createDataFrame([(k, True, "a", float(k)) for k in range(4)], "s int, side boolean, item string, v double")
    for most in (0, 5000):
        assert stability.relabelling_test(df, "s", "side", ["item"], "v", replicates=9, most=most).count() == 0
        assert stability.relabelling_test(df.limit(0), "s", "side", ["item"], "v", replicates=9, most=most).count() == 0


def test_drawn_relabellings_keep_the_sizes(spark):
    df = spark.range(50).select(F.col("id").alias("s"), (F.col("id") < 17).alias("side"))
    made, all_ways = stability.relabelled(df, "s", "side", 30)
    sizes = made.groupBy("b").agg(F.count_if("side").alias("n"), F.count(F.lit(1)).alias("m")).collect()
    assert not all_ways and len(sizes) == 31 and {(r["n"], r["m"]) for r in sizes} == {(17, 50)}


def test_interaction_by_hand(spark):
    r = np.random.default_rng(4)
    rows = [(s, "ad" if s < 5 else "jo", c, "S0", float(r.normal() + (2.0 if s < 5 and c == "GO" else 0))) for s in range(10) for c in ("GO", "NOGO")] + [(99, "ad", "GO", "S0", 50.0)]
    df = spark.createDataFrame(rows, "s int, g string, c string, state string, v double")
    found = stability.interaction(df, "s", "g", "c", ("GO", "NOGO"), ["state"], "v", ("ad", "jo")).first()
    d = np.array([rows[2 * k][4] - rows[2 * k + 1][4] for k in range(10)])
    true = d[:5].mean() - d[5:].mean()
    every = [gap(d, np.isin(np.arange(10), c)) for c in combinations(range(10), 5)]
    assert found["effect"] == pytest.approx(true) and found["p"] == pytest.approx(np.mean([abs(g) >= abs(true) - 1e-12 for g in every]))


def test_step_up(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04, 0.9, None, 1.0]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double").repartition(4)
    found = {r["id"]: r["q"] for r in stability.step_up(df).collect()}
    known = sorted(v for v in p if v is not None)
    m = len(known)
    want = lambda v: min(min(1.0, q * m / (sum(k <= q for k in known))) for q in known if q >= v)
    assert all(found[k] == pytest.approx(want(v)) if v is not None else found[k] is None for k, v in enumerate(p))


def test_transition_shares(spark):
    path = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("a", 4, 0), ("a", 5, 1), ("b", 0, 0), ("b", 1, 2)], "s string, t int, state int")
    found = {(r["s"], r["i"], r["j"]): r["p"] for r in stability.transition_shares(path, "s", ["s"], ["t"]).collect()}
    assert found == {("a", 0, 1): 1.0, ("a", 0, 2): 0.0, ("a", 1, 2): 1.0, ("a", 2, 0): 1.0, ("b", 0, 1): 0.0, ("b", 0, 2): 1.0}


def test_lines_of_a_file_of_many_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = {"one": [f"{k} {k * 2}" for k in range(5003)], "two": ["# head", "", *[f"{k},{-k}, 7" for k in range(1207)], ""]}
    for name, own in lines.items():
        (tmp_path / "in" / f"{name}.txt").write_text("\n".join(own) + "\n")
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        numbered = recordings.numbered_lines(spark, str(tmp_path / "in"))
        assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "in")).rdd.getNumPartitions() > 5
        found = {}
        for r in numbered.collect():
            found.setdefault(r["file"].rsplit("/", 1)[1][:-4], {})[r["line"]] = r["value"]
        assert found == {name: dict(enumerate(own)) for name, own in lines.items()}
        epochs = recordings.text_epochs(spark, str(tmp_path / "in"), ["Fz", "Cz"], 100).collect()
        by = {(r["file"].rsplit("/", 1)[1][:-4], r["trial"], r["channel"]): r["samples"] for r in epochs}
        assert len(by) == 2 * 50 + 2 * 12
        assert by["two", 3, "Cz"] == [-float(k) for k in range(300, 400)] and by["one", 49, "Fz"] == [float(k) for k in range(4900, 5000)]
        (tmp_path / "in" / "bad.txt").write_text("1 2\n3\n" * 60)
        with pytest.raises(Exception, match="no number for each channel"):
            recordings.text_epochs(spark, str(tmp_path / "in"), ["Fz", "Cz"], 10).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_small_probabilities_keep_their_digits(spark):
    from math import erf, erfc

    x = [-4.0, -2.5, -0.3, 0.0, 0.7, 2.0, 2.99, 3.01, 5.0, 9.0, 20.0]
    found = spark.createDataFrame([(v,) for v in x], "x double").select("x", matrices.erfc(F.col("x")).alias("c"), matrices.erf(F.col("x")).alias("e")).collect()
    for r in found:
        assert r["c"] == pytest.approx(erfc(r["x"]), rel=1e-7) and r["e"] == pytest.approx(erf(r["x"]), abs=1e-10)


def random_path(spark, seed=5):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(int(s), t, int(v)) for s in range(40) for t, v in enumerate(rng.integers(0, 2, rng.integers(1, 9)))], "s int, t int, state int").repartition(6)


def test_figures_from_runs_are_those_of_the_path(spark):
    path = random_path(spark)
    runs = states.runs(path, ["s"], ["t"])
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(states.runs_occupancy(runs, ["s"]), states.occupancy(path, ["s"]))
    assert same(states.runs_matrix(runs, ["s"]), states.transition_matrix(path, ["s"], ["t"]))


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_runs_go_on_over_sessions_and_tasks(spark, parts):
    path = random_path(spark)
    whole = [r["state"] for r in path.orderBy("s", "t").collect()]
    want, at = [], 0
    for k in range(1, len(whole) + 1):
        if k == len(whole) or whole[k] != whole[at]:
            want.append((whole[at], k - at))
            at = k
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(map(tuple, states.global_runs(path, "s", ["t"]).select("state", "length").collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_report_of_some_sections(spark):
    features = spark.createDataFrame([("a",), ("b",)], "feature string")
    meta = spark.createDataFrame([("a", "high", ["b", "c"]), ("b", None, [])], "feature string, suitability string, redundant_with array<string>")
    shape = spark.createDataFrame([("a", 1.23456)], "feature string, mean double")
    pairs = spark.createDataFrame([("a", "b", -0.9)], "feature string, other string, r double")
    found = {r["feature"]: r["report"] for r in writers.feature_report(features, {"Metadata": meta, "Distribution": shape}, pairs).collect()}
    head = "# Feature Diagnostic Report\n\n## a\n\n## Metadata\n\n- **suitability**: high\n- **redundant_with**: b, c\n\n"
    assert found["a"] == head + "## Distribution\n\n- **mean**: 1.2346\n\n## Redundancy\n\n- **redundant_pairs**:\n  - a ↔ b (corr=-0.900)\n"
    assert "- **suitability**: -" in found["b"] and "- **redundant_pairs**: -" in found["b"]
    with pytest.raises(ValueError):
        writers.feature_report(features, {"Other": shape})


def test_ends_reach_as_far_as_the_filter_rings(spark):
    b, a = kernels.band_pass(250.0, 4.0, 8.0)
    reach = kernels.ringing(b, a)
    impulse = np.zeros((1, 5000))
    impulse[0, 1000] = 1.0
    h = np.abs(kernels._run(b, a, impulse)[0, 1000:])
    assert (h[reach + 1 : 3000] <= 0.001 * h.max() * (1 + 1e-9)).all() and h[reach] > 0.001 * h.max()
    x = np.sin(2 * np.pi * 6 * np.arange(300) / 250.0)
    longer = np.concatenate([2 * x[0] - x[299:0:-1], x, 2 * x[-1] - x[-2:-301:-1]])[None]
    want = kernels._run(b, a, kernels._run(b, a, longer)[:, ::-1])[:, ::-1][:, 299:-299]
    assert reach > 299 and np.allclose(kernels.both_ways(b, a, x[None], reach), want)
    found = spark.createDataFrame([(x.tolist(),), ([1.0],), ([0.5, 1.0, 0.2],)], "s array<double>").select(kernels.envelope(F.col("s"), 250.0, 4.0, 8.0, "floor").alias("e")).collect()
    assert found[0]["e"] == pytest.approx(np.log(kernels.magnitude(want).mean() + 1e-12)) and all(np.isfinite(r["e"]) for r in found)
    assert abs(np.exp(found[0]["e"]) - 1) < 0.2  # a wave of 6 Hz passes
