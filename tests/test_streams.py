"""Streams replayed file by file, against batch forms."""

import datetime as dt

import numpy as np
import pytest
from mesostate import streaming
from mesostate.operators import models

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def files(spark, folder, batches, schema):
    """A stream of one file a batch, in their order."""
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k:03d}.parquet")
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_late_rows_are_left_out_and_windows_dropped(spark, tmp_path):
    batches = [[(at(s), "a") for s in range(k * 100, k * 100 + 100, 10)] for k in range(6)]
    batches.insert(4, [(at(5), "late"), (at(395), "in time")])
    stream = files(spark, tmp_path / "in", batches, "ts timestamp, state string")
    progress = streaming.appended(streaming.windowed_states(stream, "ts", "50 seconds", "20 seconds"), str(tmp_path / "out"), str(tmp_path / "c"))
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(p["late_rows"] for p in progress) == 1
    assert {r["state"] for r in found} == {"a", "in time"}
    assert all(r["n"] == 5 for r in found if r["state"] == "a") and len([r for r in found if r["state"] == "a"]) >= 10
    assert max(p["state_rows"] for p in progress) <= 6  # of 13 windows and states


def test_sessions_merge_and_are_dropped(spark, tmp_path):
    rows = lambda key, *seconds: [(key, at(s), "go" if s % 2 else "no") for s in seconds]
    batches = [rows("a", 0, 3, 20) + rows("b", 1), rows("a", 11) + rows("b", 100), rows("a", 200), rows("a", 30), rows("b", 400), rows("a", 600)]
    schema = "k string, ts timestamp, state string"
    stream = files(spark, tmp_path / "in", batches, schema)
    sessions = lambda df: streaming.state_sessions(df, "k", "ts", "10 seconds", "5 seconds", ["go", "no"])
    progress = streaming.appended(sessions(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    found = {(r["k"], r["start"]): (r["n"], r["n_go"], r["n_no"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {("a", at(0)): (4, 2, 2), ("b", at(1)): (1, 1, 0), ("b", at(100)): (1, 0, 1), ("a", at(200)): (1, 0, 1), ("b", at(400)): (1, 0, 1)}
    assert found == want  # 11 joins 3 and 20; 30 came too late; 600 is still open
    assert sum(p["late_rows"] for p in progress) == 1 and max(p["state_rows"] for p in progress) <= 4
    batch = {(r["k"], r["start"]): r["n"] for r in sessions(spark.createDataFrame([r for b in batches for r in b], schema)).collect()}
    assert batch[("a", at(0))] == 5 and batch[("a", at(600))] == 1


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def model():
    return models.Hmm(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.0, 0.0], [1.5, 1.0]]), np.ones((2, 2)))


def test_replay_is_the_batch_filter(spark, tmp_path, rocks):
    r = np.random.default_rng(1)
    x = {k: r.normal(size=(40, 2)) for k in ("a", "b", "c")}
    schema = "k string, ts timestamp, x array<double>"
    row = lambda k, t: (k, at(t), x[k][t].tolist())
    batches = [[row(k, t) for t in range(a, a + 10) for k in x][::-1] for a in (0, 10, 20, 30)]
    all_rows = [r for b in batches for r in b]
    batches[2] = batches[2] + [("a", at(15), [9.0, 9.0])]  # not later than what was taken
    stream = files(spark, tmp_path / "in", batches, schema)
    streaming.appended(streaming.online_filter(stream, model(), "k", "ts", "30 seconds", 60_000), str(tmp_path / "out"), str(tmp_path / "c"))
    key = ["k", "ts"]
    found = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(key)
    want = streaming.filtered(spark.createDataFrame(all_rows, schema), model(), "k", "ts").toPandas().sort_values(key)
    assert len(found) == 120 and found[key].reset_index(drop=True).equals(want[key].reset_index(drop=True))
    assert np.allclose(np.stack(found["p"]), np.stack(want["p"]))


def test_idle_sequences_start_anew(spark, tmp_path, rocks):
    schema = "k string, ts timestamp, x array<double>"
    v = [1.0, 1.0]
    batches = [[("a", at(0), v)], [("b", at(500), v)], [("b", at(550), v), ("b", at(1000), v)], [("b", at(1050), v)], [("a", at(1101), v)]]
    stream = files(spark, tmp_path / "in", batches, schema)
    progress = streaming.appended(streaming.online_filter(stream, model(), "k", "ts", "1 seconds", 100_000), str(tmp_path / "out"), str(tmp_path / "c"))
    found = {(r["k"], r["ts"]): r["p"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    first, second = found["a", at(0)], found["b", at(550)]
    assert np.allclose(found["a", at(1101)], first) and np.allclose(found["b", at(1000)], first) and np.allclose(found["b", at(1050)], second)
    assert not np.allclose(first, second) and len(found) == 6 and progress


def test_sequences_share_calls_and_state(spark, tmp_path, rocks):
    """Ninety sequences, and one without a name, in four groups and two batches, with sequences that come later, begin anew and take late rows."""
    r = np.random.default_rng(5)
    schema = "k long, ts timestamp, x array<double>"
    rows = [(k if k else None, at(t), r.normal(size=2).tolist()) for k in range(91) for t in range(k % 7, 12)]
    batches = [[v for v in rows if v[1] < at(6) and v[0] != 50], [v for v in rows if v[1] >= at(6) or v[0] == 50] + [(3, at(4), [9.0, 9.0])]]
    stream = files(spark, tmp_path / "in", batches, schema)
    progress = streaming.appended(streaming.online_filter(stream, model(), "k", "ts", "30 seconds", 60_000, dealt=4), str(tmp_path / "out"), str(tmp_path / "c"))
    found = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["k", "ts"])
    want = streaming.filtered(spark.createDataFrame(rows, schema), model(), "k", "ts").toPandas().sort_values(["k", "ts"])
    assert len(found) == len(rows) and found["k"].isna().sum() == 12 and np.allclose(np.stack(found["p"]), np.stack(want["p"]))
    assert max(p["state_rows"] for p in progress) < 30  # values and timers of five groups, not of ninety-one sequences


def test_filters_side_by_side_are_single_filters():
    r = np.random.default_rng(6)
    lengths = np.array([3, 1, 8, 5])
    obs, anew, ahead = r.normal(size=(17, 2)), r.random(17) < 0.2, r.dirichlet([1, 1], 4)
    ends = np.cumsum(lengths)
    found = streaming.filtering.forward_all(model(), obs, lengths, anew, ahead)
    for a, b, v in zip(ends - lengths, ends, ahead, strict=True):
        want = v
        for t in range(a, b):
            dens = np.exp(model().log_density(obs[t : t + 1])[0])
            want = dens * (model().start if anew[t] else want @ model().step)
            want = want / want.sum()
            assert np.allclose(found[t], want)


def test_filter_against_smoothing(spark):
    obs = np.random.default_rng(2).normal(size=(9, 2))
    ahead = streaming.filtering.forward(model(), obs, None)
    for t in range(9):  # the last posterior of the rows so far
        assert np.allclose(ahead[t], model().forward_backward(obs[: t + 1])[1][-1])
    split = streaming.filtering.forward(model(), obs[4:], ahead[3])
    assert np.allclose(split, ahead[4:])


def test_the_registered_stream_is_the_batch_filter(spark):
    from pyspark.sql import functions as F

    from mesostate.plans import deeper

    d = "/root/testdata/sf0.001"
    found = deeper.QUERIES["stream_filter"](spark, d).toPandas().sort_values(["session", "ts"])
    rows = spark.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.array("value").alias("x"))
    fitted = models.fit_hmm(rows, ["session"], "ts", 2, n_iter=10)
    want = streaming.filtered(rows, fitted, "session", "ts").toPandas().sort_values(["session", "ts"])
    assert len(found) == len(want) > 0 and np.allclose(np.stack(found["p"]), np.stack(want["p"]), atol=1e-6)
