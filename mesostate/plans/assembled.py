"""Registered queries of names, features, signal quality, model comparison, sources and sinks, and their SQL for DuckDB.

Kernels, fits and files have no SQL; tests hold them against other forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesostate import functions, streaming
from mesostate.operators import comparison, diagnostics, features, kernels, labels, matrices, models, signals, states, statequality
from mesostate.plans.catalogue import _A, _E, _M, _MATRIX, _P, _TR, ORDER, SCOPE, STEP_SEC, epochs, matrix, path, rounded, table, trials
from mesostate.plans.extended import _K2, _PO, posterior
from mesostate.sources import readers, writers
from mesostate.storage import checkpoint, scratch

ADULTS = ["BUI", "MAC"]
EXCLUDED = ["búi1", "MÁC2"]
#: Names of recordings, made of the customers in words that both engines know.
NAME = "concat(upper(substr(c_mktsegment, 1, 3)), c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'SINGO' WHEN 1 THEN 'NOGO' WHEN 2 THEN 'NG' WHEN 3 THEN 'GO' ELSE 'X' END)"
FILE = "concat(upper(substr(c_mktsegment, 1, 3)), c_custkey, '_', CASE c_custkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'NOGO' ELSE 'x' END, '_clean')"
CONDITION = "CASE WHEN c_custkey % 2 = 0 THEN 'GO' ELSE 'NOGO' END"
#: Sampling rate at which 64 samples have a bin a Hertz.
RATE = 64.0
ABSORBING = 0.28


def _customers(s, d) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", "c_mktsegment", F.expr(NAME).alias("name"), F.expr(FILE).alias("file"), F.expr(CONDITION).alias("cond"))


def _p1(s, d) -> DataFrame:
    return _customers(s, d).select("file", labels.condition(F.col("file"), F.when(F.col("c_custkey") % 7 == 0, "GO")).alias("condition"))


def _p2(s, d) -> DataFrame:
    return _customers(s, d).select("name", F.inline(F.array(labels.parse_name(F.concat("name", F.lit("_sin_contexto_epo")), ADULTS))))


def _files(s, d) -> DataFrame:
    known = _customers(s, d).select(F.concat(F.substring("c_mktsegment", 1, 3), F.col("c_custkey")).alias("subject"), F.col("cond").alias("condition"))
    return labels.match_names(_customers(s, d).select(F.concat("name", F.lit("_"), F.col("cond"), F.lit("_features")).alias("file"), F.col("cond").alias("condition")), known)


def _pairs(s, d) -> DataFrame:
    given = _customers(s, d).select("name", labels.base_subject(F.concat(F.col("c_mktsegment"), F.expr("c_custkey div 2"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'SINGO' ELSE 'SINNOGO' END"))).alias("base"), F.when(F.col("c_custkey") % 2 == 0, "GO").otherwise("NOGO").alias("condition"))
    return labels.condition_pairs(given, "base", "condition", "name")


def other_path(s, d) -> DataFrame:
    """The path of a second model of the same sessions, of four states."""
    return table(s, d, "events").select(F.col("user_id").alias("session"), "ts", "event_id", F.concat(F.lit("S"), (F.col("event_id") % 4)).alias("state"))


def _absorbers(s, d) -> tuple[DataFrame, DataFrame]:
    found = (statequality.absorbing(states.occupancy(p(s, d), SCOPE), over) for p, over in ((path, ABSORBING), (other_path, 0.33)))
    return tuple(f.withColumn("base", F.expr("session div 2")) for f in found)


def _j6(s, d) -> DataFrame:
    return rounded(labels.compare_absorbers(*_absorbers(s, d), "base"), "fo_a", "fo_b")


def _experiment_ids(s, d) -> DataFrame:
    c = table(s, d, "customer")
    lag = F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey"))
    return c.select("c_custkey", labels.experiment_id(F.lower("c_mktsegment"), F.lit("hmm"), F.col("c_custkey") % 5 + 2, F.lit(90), lag, F.lit("car"), F.when(F.col("c_custkey") % 4 == 0, F.lit(250))).alias("experiment"))


# signals ----------------------------------------------------------------------------------------------------------


def recording(s, d) -> DataFrame:
    """Whole trials of all channels: each vector is one channel of one trial, in the order of the montage."""
    n = len(features.CHANNELS)
    e = epochs(s, d).select(F.expr(f"vec_id div {n}").alias("trial"), F.element_at(F.lit(list(features.CHANNELS)), (F.col("vec_id") % n + 1).cast("int")).alias("channel"), "samples")
    whole = e.groupBy("trial").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("trial")
    return e.join(whole, "trial", "left_semi").withColumn("session", F.col("trial") % 5)


def _features(names: list[str], size: int = 32, step: int = 16, raw_bands: bool = True):
    def query(s, d) -> DataFrame:
        windows = signals.sliding_windows(recording(s, d), size, step)
        vectors = features.assemble(windows, [features.REGISTRY.get(n) for n in names], rate=250.0, raw_bands=raw_bands)
        return vectors.select("session", "trial", "win_idx", F.posexplode("x").alias("dim", "x")).withColumn("x", F.round("x", 6))

    return query


def _channels(s, d) -> DataFrame:
    return epochs(s, d).select("session", F.expr("vec_id % 4").alias("channel"), "vec_id", "samples")


def _mean_psd(s, d) -> DataFrame:
    mean = diagnostics.trial_mean(_channels(s, d), ["session", "channel"])
    return mean.select("session", "channel", F.inline(kernels.welch("samples", RATE)))


def _verdicts(s, d) -> DataFrame:
    emg = diagnostics.power_ratios(_mean_psd(s, d), "session", "channel").select("session", "emg")
    long = _channels(s, d).select("session", F.col("channel").alias("dim"), F.explode("samples").alias("x"))
    level = diagnostics.channel_levels(long, ["session"], 1.2).groupBy("session").agg(F.avg("rms").alias("rms"), F.count_if("bad").alias("n_bad"))
    amplitude = diagnostics.amplitudes(epochs(s, d), "session", 0.40, 0.35).select("session", "pct_high", "pct_low")
    found = diagnostics.signal_verdict(level.join(emg, "session").join(amplitude, "session"), 0.1245, 0.126)
    return rounded(found.select("session", "rms", "emg", "n_bad", "rms_flag", "emg_flag", "verdict"), "rms", "emg", digits=5)


# diagnostics ------------------------------------------------------------------------------------------------------


def _judged(s, d) -> DataFrame:
    long = matrix(s, d)
    shape = matrices.distribution(long).select("dim", "skew", "kurt", "sd").join(matrices.outliers(long).withColumnRenamed("share", "outliers"), "dim").join(diagnostics.normality(long), "dim")
    found = diagnostics.judged(diagnostics.gaussianity(shape), friendly=True)
    return rounded(found.select("dim", "score", "label", "consistent", "near_constant", "warnings"), "score", digits=5)


# models -----------------------------------------------------------------------------------------------------------


def decoded(s, d) -> DataFrame:
    """Rows with the posterior of ``posterior`` and its most likely state."""
    p = posterior(s, d)
    return p.select("session", "vec_id", F.col("p").alias("posterior"), (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("state"))


def _state_table(s, d) -> DataFrame:
    found = checkpoint(decoded(s, d))
    table_ = statequality.state_table(found, states.runs(found, ["session"], ["vec_id"]), states.transition_matrix(found, ["session"], ["vec_id"]), 100.0)
    return rounded(table_, "fo_hard", "fo_soft", "self_trans", "dwell_analytic", "dwell_median", "dwell_mean", "dwell_p95", "confidence", "entropy", digits=5)


def _scores(s, d) -> DataFrame:
    rows = epochs(s, d).select("session", F.floor(F.col("vec_id") / 32).alias("trial"), "vec_id", "samples")
    return models.principal_components(rows, 0.3, "samples").transform(rows, "samples", "x").select("session", "trial", "vec_id", "x")


def _fit(covariance: str, k: int = 3):
    def query(s, d) -> DataFrame:
        rows = checkpoint(_scores(s, d))
        fitted = models.fit_hmm(rows, ["session", "trial"], "vec_id", k, covariance=covariance)
        return fitted.decode(rows, ["session", "trial"], "vec_id")

    return query


def _convergence(s, d) -> DataFrame:
    return models.fit_hmm(checkpoint(_scores(s, d)), ["session", "trial"], "vec_id", 2, covariance="tied").record(s)


def _lengths(s, d) -> DataFrame:
    """Sessions whose events are not as many as the customers' balance says, in a table of stated lengths."""
    stated = table(s, d, "customer").select(F.col("c_custkey").alias("session"), (F.col("c_custkey") % 40 + 45).alias("n"))
    return models.check_lengths(path(s, d), stated, "session")


# comparison -------------------------------------------------------------------------------------------------------


def _columns(s, d) -> DataFrame:
    dims = matrix(s, d).select("dim").distinct()
    return dims.select("dim", F.concat(F.lit("feature"), F.expr("dim div 16")).alias("feature"), F.lit("0").alias("part"), F.concat(F.lit("c"), F.expr("dim % 16")).alias("channel"))


def _two(s, d) -> tuple[DataFrame, DataFrame]:
    """Profiles of two models of four states over the same rows."""
    a = matrix(s, d).withColumn("a", F.expr("session % 4")).withColumn("b", F.expr("session div 3"))
    return comparison.profiles(a, "a"), comparison.profiles(a, "b")


def _summary(s, d, which) -> DataFrame:
    """From the runs of a path, which is read once."""
    runs = checkpoint(states.runs(which(s, d), SCOPE, ORDER))
    dwell = statequality.dwell_statistics(runs, 100.0).select("state", F.col("mean").alias("dwell"))
    sure = states.runs_matrix(runs, SCOPE).groupBy("i").agg(F.max("p").alias("p")).agg(F.avg("p"))
    return comparison.experiment_summary(checkpoint(states.runs_occupancy(runs, SCOPE)), dwell, sure, ABSORBING)


def _leaderboard(s, d) -> DataFrame:
    both = _summary(s, d, path).withColumn("experiment", F.lit("events")).unionByName(_summary(s, d, other_path).withColumn("experiment", F.lit("parity")))
    return rounded(comparison.leaderboard(both), "fo_min", "fo_max", "dwell_max", "confidence", "pct_absorbing")


def _methods(s, d) -> DataFrame:
    both = states.occupancy(path(s, d), SCOPE).withColumn("method", F.lit("events")).unionByName(states.occupancy(other_path(s, d), SCOPE).withColumn("method", F.lit("parity")))
    groups = table(s, d, "customer").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("grp"), F.expr(CONDITION).alias("cond"))
    return rounded(comparison.method_occupancy(both.join(groups, "session"), ["method", "cond", "grp", "state"]), "mean", "sem")


def _absorbing_vectors(s, d, found: DataFrame | None = None) -> DataFrame:
    """Sessions that the mixture gives over a fifth of their windows to one state."""
    return statequality.absorbing(states.occupancy(decoded(s, d) if found is None else found, ["session"]), 0.2)


def _absorber_profile(s, d) -> DataFrame:
    long = matrix(s, d).withColumn("kind", F.concat(F.lit("feature"), F.expr("dim div 16")))
    return rounded(comparison.absorber_profile(long, _absorbing_vectors(s, d), "session", "kind"), "z", digits=5)


def _absorber_table(s, d) -> DataFrame:
    found, m = checkpoint(decoded(s, d)), matrix(s, d)
    means = matrices.centroids(m, "session").withColumnRenamed("session", "state")
    p = found.select("session", F.posexplode("posterior").alias("state", "p"))
    moves = states.transitions(found, ["session"], ["vec_id"], STEP_SEC)
    table_ = comparison.absorber_table(_absorbing_vectors(s, d, found), moves, comparison.centroid_distance(m, means, "session"), p, "session", 0.3)
    return rounded(table_, "fo", "z_distance", "above", digits=4)


def _health(s, d) -> DataFrame:
    runs = checkpoint(states.runs(path(s, d), SCOPE, ORDER))
    fo = checkpoint(states.runs_occupancy(runs, SCOPE))
    kept = statequality.attractors(states.runs_matrix(runs, SCOPE), 100.0).select("state", F.col("self").alias("self_trans"), F.col("dwell").alias("dwell_analytic"))
    sessions = fo.groupBy("session").agg(F.max("fo").alias("m")).agg(F.count_if(F.col("m") > 0.33).alias("absorbing"), F.count_if(F.col("session") % 2 == 0).alias("go"), F.count_if(F.col("session") % 2 == 1).alias("nogo"))
    given = fo.groupBy("state").agg(F.avg("fo").alias("fo")).join(kept, "state").crossJoin(sessions)  # one row
    checks = statequality.health(given, F.lit(0.7), F.col("absorbing"), F.greatest("go", "nogo"), F.least("go", "nogo"))
    return rounded(checks, "value", digits=5)


# files ------------------------------------------------------------------------------------------------------------


def _label_files(s, d) -> DataFrame:
    """Labels written as CSV, read back, and joined to sessions of which some are not in it (SRC7, SNK17)."""
    out = scratch(s, "labels")
    c = _customers(s, d)
    c.where("c_custkey % 4 <> 0").select(F.concat("name", F.lit("_sin_contexto_features.npy")).alias("npy_file"), F.col("name").alias("subject_id"), F.col("cond").alias("condition"), F.col("c_mktsegment").alias("grp")).write.csv(out, header=True)
    return readers.labelled(c.select(F.lower("name").alias("session")), readers.labels(s, out)).select("session", "condition", "grp")


def _feature_files(s, d) -> DataFrame:
    """Features written once, asked for again and not written anew, and read back (SNK2)."""
    out, given = scratch(s, "features"), matrix(s, d)
    first = writers.features(given, out, {"table": "embeddings", "step": 1})
    if writers.features(given.limit(0), out, {"step": 1, "table": "embeddings"}) != first:
        raise AssertionError("equal descriptions have different names")
    return s.read.parquet(first).select("row", F.col("session").cast("int").alias("session"), "dim", F.round("x", 6).alias("x"))


def _experiment_files(s, d) -> DataFrame:
    """Two experiments written with all they leave, a third without, read back as one table (SNK9 to SNK13, SRC12)."""
    out = scratch(s, "experiments")
    for name, which in (("events", path), ("parity", other_path)):
        p = which(s, d)
        stats = statequality.dwell_statistics(states.runs(p, SCOPE, ORDER), 100.0)
        writers.experiment(f"{out}/{name}", stats, states.occupancy(p, SCOPE), _summary(s, d, which), p)
    tables, left_out = readers.experiments(s, {n: f"{out}/{n}" for n in ("events", "parity", "missing")})
    if left_out != ["missing"]:
        raise AssertionError(f"left out: {left_out}")
    return tables["fo_by_session"].groupBy("experiment", "state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fo"), 5).alias("fo"))


def _csv_results(s, d) -> DataFrame:
    """Result tables as one CSV file, read back (SNK9, SRC11)."""
    out = scratch(s, "results")
    writers.single_file(rounded(statequality.dwell_statistics(states.runs(path(s, d), SCOPE, ORDER), 100.0), "mean", "median", "p95", digits=4), out)
    return readers.results(s, out, "state string, mean double, median double, p95 double, n_runs long, n_windows long")


def _json_split(s, d) -> DataFrame:
    """The split of subjects as JSON, read back (SNK14, SNK16, SRC10)."""
    out = scratch(s, "split")
    writers.as_json(models.split(table(s, d, "customer"), "c_custkey")).write.text(out)
    return s.read.schema("c_custkey long, test boolean").json(out)


def _report(s, d) -> DataFrame:
    """A Markdown report a dimension (SNK15)."""
    shape = rounded(matrices.distribution(matrix(s, d)).select("dim", "mean", "sd"), "mean", "sd", digits=6)
    text = writers.markdown(shape, F.concat(F.lit("dimension "), F.col("dim").cast("string")), {"distribution": ["mean", "sd"]})
    return text.select("dim", F.length("report").alias("n_chars"), F.element_at(F.split("report", "\n"), 1).alias("title"))


def _stream(s, d) -> DataFrame:
    """Hourly shares of states of the events, read as a stream."""
    out, source = scratch(s, "stream"), f"{d}/events.parquet"
    events = s.readStream.schema(s.read.parquet(source).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")
    counts = streaming.windowed_states(events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("state")), "ts", "1 hour", "1 day")
    streaming.replayed(counts, out, scratch(s, "stream-state"))
    return s.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "state", "n")


def _sql_functions(s, d) -> DataFrame:
    """Features by the library's SQL functions."""
    functions.register(s)
    epochs(s, d).createOrReplaceTempView("meso_epochs")
    return s.sql("SELECT vec_id, round(meso_mobility(samples), 6) AS mobility FROM meso_epochs")


QUERIES = {
    "p1_condition": _p1,
    "p2_names": _p2,
    "p3_without_prefixes": lambda s, d: labels.without_prefixes(_customers(s, d).select("name"), "name", EXCLUDED),
    "lbl1_bases": lambda s, d: _customers(s, d).select("name", labels.base_subject(F.col("name")).alias("base")),
    "j4_names": _files,
    "j5_pairs": _pairs,
    "j6_absorbers": _j6,
    "set_absorbers": lambda s, d: labels.set_members(*[a.select("base").distinct() for a in _absorbers(s, d)], "base"),
    "experiment_ids": _experiment_ids,
    "win2_trimmed": lambda s, d: signals.sliding_windows(epochs(s, d), 20, 20, 1).select("vec_id", "win_idx", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 6).alias("total")),
    "tde3_channels": lambda s, d: signals.embed_channels(_channels(s, d), ["session", "vec_id"], "channel", 1, 4).select("session", "vec_id", "t", F.posexplode("x").alias("place", "x")).withColumn("x", F.round("x", 6)),
    "f13_temporal": _features(["hjorth_mobility", "hjorth_complexity", "temporal_entropy"]),
    "f13_all": _features(features.REGISTRY.names()),
    "f12_dependents": _features(["alpha_envelope", "relative_power", "band_ratios", "hemispheric_asymmetry"], raw_bands=False),
    "qc3_trial_mean": lambda s, d: rounded(_mean_psd(s, d), "p", digits=9),
    "qc5_ratios": lambda s, d: rounded(diagnostics.power_ratios(_mean_psd(s, d), "session", "channel"), "beta_alpha", "theta_alpha", "emg", digits=5),
    "qc8_verdict": _verdicts,
    "qc9_reference": lambda s, d: rounded(diagnostics.reference_spectrum(_mean_psd(s, d).groupBy("session", "f").agg(F.avg("p").alias("p"))), "mean_db", "low_db", "high_db", digits=4),
    "dg9_judged": _judged,
    "dg10_report": lambda s, d: rounded(diagnostics.smoothness_report(diagnostics.smoothness(matrix(s, d), ["session"], "row"), ["session"]), "lag1_mean", "lag1_sd", "step_mean", "step_sd", "noise", digits=5),
    "dg11_report": lambda s, d: rounded(diagnostics.stationarity_report(diagnostics.stationarity(matrix(s, d), ["session"], "row"), ["session"]), "slope_mean", "slope_sd", "shift_mean"),
    "dg12_kpss": lambda s, d: rounded(diagnostics.kpss(matrix(s, d), ["session"], "row"), "kpss", "p", digits=5),
    "dg15_redundant": lambda s, d: rounded(matrices.redundant(matrices.correlations(epochs(s, d), "samples"), 0.05), "r", digits=5),
    "dg22_separability": lambda s, d: rounded(matrices.separability(matrices.centroid_distances(matrix(s, d), "session")), "mean", "sd", "least", "most", digits=5),
    "m1_standardised": lambda s, d: rounded(matrices.standardised(matrix(s, d)).select("row", "dim", "z"), "z", digits=5),
    "m4_full": _fit("full"),
    "m4_tied": _fit("tied"),
    "m7_convergence": _convergence,
    "m8_lengths": _lengths,
    "m11_geometry": lambda s, d: rounded(matrices.geometry(matrix(s, d), "session"), "norm", "mean_variance", "most_variance"),
    "m13_curve": lambda s, d: rounded(models.principal_components(epochs(s, d), 0.9, "samples").curve(s), "ratio", "cumulative"),
    "st7_state_table": _state_table,
    "st8_global_runs": lambda s, d: states.global_runs(path(s, d), "session", ORDER).groupBy("state", "length").agg(F.count(F.lit(1)).alias("n")),
    "st18_trial_dwell": lambda s, d: rounded(states.trial_dwell(trials(s, d), ["session", "trial"], ORDER, 100.0, absent=0.0), "dwell"),
    "ev2_times": lambda s, d: rounded(statequality.profile(trials(s, d).withColumn("ms", states.window_times(F.col("pos"), -500.0, 300.0, 100.0, 1)), "ms"), "p"),
    "ev5_courses": lambda s, d: rounded(states.courses_apart(*[statequality.profile(trials(s, d).withColumn("pos", F.col("pos").cast("int")).where(f"session % 2 = {k}"), "pos") for k in (0, 1)], "pos"), "delta"),
    "stat5_health": _health,
    "stat5_fitness": lambda s, d: statequality.fit_for_report(_health(s, d)),
    "cmp3_between_models": lambda s, d: rounded(comparison.likeness(*_two(s, d)), "cosine", "distance", digits=5),
    "cmp4_assignment": lambda s, d: rounded(comparison.assignment(comparison.likeness(*_two(s, d))), "cosine", digits=5),
    "cmp5_profile_table": lambda s, d: rounded(comparison.profile_table(comparison.profiles(matrix(s, d), "session"), _columns(s, d)), "z", "limit", digits=5),
    "cmp6_leaderboard": _leaderboard,
    "cmp7_methods": _methods,
    "cmp9_raw_likeness": lambda s, d: rounded(comparison.likeness(comparison.raw_profiles(matrix(s, d), "session")), "cosine", "distance", digits=5),
    "abs1_profile": _absorber_profile,
    "abs4_table": _absorber_table,
    "top_balanced": lambda s, d: rounded(comparison.most_balanced(states.occupancy(path(s, d), SCOPE), "session", 5), "spread", "most"),
    "stream_states": _stream,
    "u6_functions": _sql_functions,
    "src7_labels": _label_files,
    "snk2_features": _feature_files,
    "snk9_results": _csv_results,
    "snk13_experiments": _experiment_files,
    "snk15_report": _report,
    "snk16_split": _json_split,
}

_C = f"c AS (SELECT c_custkey, c_mktsegment, {NAME} AS name, {FILE} AS file, {CONDITION} AS cond FROM customer)"
_BASE = "CASE WHEN ends_with({0}, 'NOGO') THEN left({0}, length({0}) - 4) WHEN ends_with({0}, 'SINGO') THEN left({0}, length({0}) - 2) WHEN ends_with({0}, 'NGO') THEN left({0}, length({0}) - 3) WHEN ends_with({0}, 'NG') OR ends_with({0}, 'GO') THEN left({0}, length({0}) - 2) ELSE {0} END"
_P2S = "p2 AS (SELECT user_id AS session, ts, event_id, 'S' || (event_id % 4) AS state FROM events)"
_FO2 = "fo2 AS (SELECT n.session, s.state, count(p2.event_id) / n.n::DOUBLE AS fo FROM n CROSS JOIN (SELECT DISTINCT state FROM p2) s LEFT JOIN p2 ON p2.session = n.session AND p2.state = s.state GROUP BY n.session, s.state, n.n)"
_AB = f"{_A}, {_P2S}, {_FO2}, aa AS (SELECT session // 2 AS base, state, fo FROM fo WHERE fo > {ABSORBING}), bb AS (SELECT session // 2 AS base, state, fo FROM fo2 WHERE fo > 0.33), sa AS (SELECT * FROM aa QUALIFY row_number() OVER (PARTITION BY base ORDER BY fo DESC, state DESC) = 1), sb AS (SELECT * FROM bb QUALIFY row_number() OVER (PARTITION BY base ORDER BY fo DESC, state DESC) = 1)"
_NC = len(features.CHANNELS)
_REC = f"""{_E}, rc AS (SELECT vec_id // {_NC} AS trial, {list(features.CHANNELS)!r}[(vec_id % {_NC} + 1)::INT] AS channel, (vec_id % {_NC})::INT AS ci, x, count(*) OVER (PARTITION BY vec_id // {_NC}) AS n FROM e),
wi AS (SELECT trial % 5 AS session, trial, ci, w::INT AS win_idx, x[w * 16 + 1 : w * 16 + 32] AS x FROM (SELECT *, unnest(range(3)) AS w FROM rc WHERE n = {_NC})), wl AS (SELECT session, trial, ci, win_idx, unnest(range(32)) AS t, unnest(x) AS x FROM wi),
d1 AS (SELECT *, x - lag(x) OVER w AS d FROM wl WINDOW w AS (PARTITION BY trial, ci, win_idx ORDER BY t)), d2 AS (SELECT *, d - lag(d) OVER w AS dd, min(x) OVER (PARTITION BY trial, ci, win_idx) AS lo, max(x) OVER (PARTITION BY trial, ci, win_idx) AS hi FROM d1 WINDOW w AS (PARTITION BY trial, ci, win_idx ORDER BY t)),
hj AS (SELECT session, trial, ci, win_idx, var_pop(x) AS v0, var_pop(d) AS v1, var_pop(dd) AS v2 FROM d2 GROUP BY ALL), eb AS (SELECT trial, ci, win_idx, least(floor((x - lo) / (hi - lo) * 10), 9) AS b, count(*) / 32.0::DOUBLE AS p FROM d2 GROUP BY ALL), en AS (SELECT trial, ci, win_idx, -sum(p * log2(p)) AS h FROM eb GROUP BY ALL)"""
_DFT = f"""{_M}, ch AS (SELECT session, row % 4 AS channel, dim AS t, avg(x) AS x FROM m GROUP BY ALL), cd AS (SELECT *, (x - avg(x) OVER (PARTITION BY session, channel)) * (0.5 - 0.5 * cos(2 * pi() * t / 64)) AS w FROM ch),
cs AS (SELECT session, channel, f, sum(w * cos(2 * pi() * f * t / 64)) AS c, sum(w * sin(2 * pi() * f * t / 64)) AS s FROM cd CROSS JOIN (SELECT unnest(range(1, 33)) AS f) GROUP BY ALL),
ps AS (SELECT session, channel, f::DOUBLE AS f, (c * c + s * s) / ({RATE} * 24) * CASE WHEN f = 32 THEN 1 ELSE 2 END AS p FROM cs)"""
_AREA = "coalesce(sum((f2 - f) * (p2 + p) / 2) FILTER (f >= {0} AND f2 <= {1}), 0)"
_QR = f"""{_DFT}, nx AS (SELECT *, lead(f) OVER w AS f2, lead(p) OVER w AS p2 FROM ps WINDOW w AS (PARTITION BY session, channel ORDER BY f)), bp AS (SELECT session, channel, {_AREA.format(8, 13)} AS a, {_AREA.format(13, 30)} AS b, {_AREA.format(4, 8)} AS t FROM nx GROUP BY ALL),
ra AS (SELECT session, avg(b / (a + 1e-30)) AS beta_alpha, avg(t / (a + 1e-30)) AS theta_alpha FROM bp GROUP BY ALL), mp AS (SELECT session, f, avg(p) AS p FROM ps GROUP BY ALL), mx AS (SELECT *, lead(f) OVER w AS f2, lead(p) OVER w AS p2 FROM mp WINDOW w AS (PARTITION BY session ORDER BY f)),
em AS (SELECT session, {_AREA.format(20, 45)} / ({_AREA.format(1, 1000)} + 1e-30) AS emg FROM mx GROUP BY ALL)"""
_DE = f"{_PO}, de AS (SELECT session, vec_id, p, (list_position(p, list_max(p)) - 1)::INT AS state FROM po), dl AS (SELECT *, lag(state) OVER w AS prev, lead(state) OVER w AS nxt FROM de WINDOW w AS (PARTITION BY session ORDER BY vec_id))"
_DO = "dn AS (SELECT session, count(*) AS n FROM de GROUP BY session), dfo AS (SELECT dn.session, s.state, count(de.vec_id) / dn.n::DOUBLE AS fo FROM dn CROSS JOIN (SELECT DISTINCT state FROM de) s LEFT JOIN de ON de.session = dn.session AND de.state = s.state GROUP BY dn.session, s.state, dn.n), dab AS (SELECT * FROM dfo WHERE fo > 0.2)"
_SC = "sc AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM m GROUP BY dim)"
_TWO = f"WITH {_M}, {_SC}, zz AS (SELECT session, dim, (x - mu) / sd AS z FROM m JOIN sc USING (dim)), pa AS (SELECT session % 4 AS i, dim, avg(z) AS z FROM zz GROUP BY ALL), pb AS (SELECT session // 3 AS j, dim, avg(z) AS z FROM zz GROUP BY ALL), lk AS (SELECT i, j, sum(pa.z * pb.z) / sqrt(sum(pa.z ** 2) * sum(pb.z ** 2)) AS cosine, sqrt(sum((pa.z - pb.z) ** 2)) AS distance FROM pa JOIN pb USING (dim) GROUP BY ALL)"


def _summary_sql(name: str, p: str, fo: str) -> str:
    return f"""g_{p} AS (SELECT *, lag(state) OVER w AS prev, lead(state) OVER w AS nxt FROM {p} WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
r_{p} AS (SELECT session, state, sum(CASE WHEN prev = state THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY ts, event_id) AS run FROM g_{p}), l_{p} AS (SELECT state, count(*) AS n FROM r_{p} GROUP BY session, state, run),
w_{p} AS (SELECT max(d) AS d FROM (SELECT avg(n * 100.0::DOUBLE) AS d FROM l_{p} GROUP BY state)), c_{p} AS (SELECT avg(c) AS c FROM (SELECT max(n) / sum(n)::DOUBLE AS c FROM (SELECT state, nxt, count(*) AS n FROM g_{p} WHERE nxt IS NOT NULL GROUP BY ALL) GROUP BY state)),
f_{p} AS (SELECT min(f) AS lo, max(f) AS hi, count(*) AS k FROM (SELECT avg(fo) AS f FROM {fo} GROUP BY state)), a_{p} AS (SELECT count(*) AS n_sessions, count(*) FILTER (m > {ABSORBING}) AS n_absorbing FROM (SELECT max(fo) AS m FROM {fo} GROUP BY session)),
s_{p} AS (SELECT '{name}' AS experiment, lo AS fo_min, hi AS fo_max, k, n_sessions, n_absorbing, d AS dwell_max, c AS confidence, ((lo >= 0.1)::INT + (d <= 2000)::INT + (hi - lo <= 0.3)::INT + (c >= 0.6)::INT) AS score FROM f_{p}, a_{p}, w_{p}, c_{p})"""


_HEALTH = f"""{_A}, tm AS ({_MATRIX.format('')}), atr AS (SELECT i AS state, coalesce(max(p) FILTER (i = j), 0)::DOUBLE AS s, 100.0 / greatest(1 - coalesce(max(p) FILTER (i = j), 0)::DOUBLE, 1e-9) AS dw FROM tm GROUP BY i),
fs AS (SELECT min(f) AS lo, max(f) - min(f) AS rg FROM (SELECT avg(fo) AS f FROM fo GROUP BY state)), se AS (SELECT count(*) FILTER (m > 0.33) AS ab, count(*) FILTER (session % 2 = 0) AS go, count(*) FILTER (session % 2 = 1) AS nogo FROM (SELECT session, max(fo) AS m FROM fo GROUP BY session)),
he AS (SELECT 'dwell ' || state AS item, CASE WHEN s > 0.97 OR dw > 5000 THEN 'critical' ELSE 'ok' END AS grade, dw AS value FROM atr
UNION ALL SELECT 'fo balance', CASE WHEN lo < 0.1 THEN 'critical' ELSE 'ok' END, CASE WHEN lo < 0.1 THEN lo ELSE rg END FROM fs UNION ALL SELECT 'confidence', 'warning', 0.7::DOUBLE
UNION ALL SELECT 'absorbing', CASE WHEN ab = 0 THEN 'ok' WHEN ab <= 3 THEN 'warning' ELSE 'critical' END, ab::DOUBLE FROM se UNION ALL SELECT 'condition balance', CASE WHEN greatest(go, nogo) / least(go, nogo)::DOUBLE < 1.3 THEN 'ok' ELSE 'warning' END, greatest(go, nogo) / least(go, nogo)::DOUBLE FROM se)"""

SQL = {
    "p1_condition": f"WITH {_C} SELECT file, CASE WHEN regexp_matches(file, '(?i)_(NOGO|GO)_') THEN upper(regexp_extract(file, '(?i)_(NOGO|GO)_', 1)) WHEN c_custkey % 7 = 0 THEN 'GO' ELSE 'UNKNOWN' END AS condition FROM c",
    "p2_names": f"WITH {_C}, q AS (SELECT name, regexp_replace(name, '(NOGO|NG|GO)$', '') AS subject FROM c) SELECT name, subject, CASE WHEN left(subject, 3) IN ('BUI', 'MAC') THEN 'ADULTO' ELSE 'ADOLESCENTE' END AS grp, CASE WHEN regexp_matches(name, '(NOGO|NG)$') THEN 'NOGO' ELSE 'GO' END AS condition FROM q",
    "p3_without_prefixes": f"WITH {_C} SELECT name FROM c WHERE NOT starts_with(name, 'BUI1') AND NOT starts_with(name, 'MAC2')",
    "lbl1_bases": f"WITH {_C} SELECT name, {_BASE.format('name')} AS base FROM c",
    "j4_names": f"WITH {_C}, f AS (SELECT name || '_' || cond || '_features' AS file, cond FROM c), l AS (SELECT left(c_mktsegment, 3) || c_custkey AS subject, cond FROM c), h AS (SELECT file, f.cond, count(*) AS n, min(subject) AS s FROM f JOIN l ON f.cond = l.cond AND contains(upper(file), upper(subject)) GROUP BY ALL) SELECT file, f.cond AS condition, CASE WHEN n = 1 THEN s END AS subject, CASE WHEN n IS NULL THEN 'no match' WHEN n > 1 THEN 'several matches' END AS reason FROM f LEFT JOIN h USING (file, cond)",
    "j5_pairs": f"WITH {_C}, b AS (SELECT name, c_custkey % 2 AS k, upper(c_mktsegment) || (c_custkey // 2) || 'SIN' AS base FROM c) SELECT a.base, a.name AS go, o.name AS nogo FROM b a JOIN b o ON a.base = o.base AND a.k = 0 AND o.k = 1",
    "j6_absorbers": f"{_AB} SELECT base, sa.state AS state_a, round(sa.fo, 6) AS fo_a, sb.state AS state_b, round(sb.fo, 6) AS fo_b, sa.fo IS NOT NULL AS in_a, sb.fo IS NOT NULL AS in_b, sa.fo IS NOT NULL AND sb.fo IS NOT NULL AS in_both FROM sa FULL JOIN sb USING (base)",
    "set_absorbers": f"{_AB} SELECT base, 'both' AS \"where\" FROM sa JOIN sb USING (base) UNION ALL SELECT base, 'only_a' FROM sa ANTI JOIN sb USING (base) UNION ALL SELECT base, 'only_b' FROM sb ANTI JOIN sa USING (base) UNION ALL SELECT base, 'any' FROM (SELECT base FROM sa UNION SELECT base FROM sb)",
    "experiment_ids": "SELECT c_custkey, concat_ws('_', lower(c_mktsegment), 'hmm', 'K' || (c_custkey % 5 + 2), 'PCA90', CASE WHEN c_custkey % 3 = 0 THEN 'L' || c_nationkey END, 'CAR', CASE WHEN c_custkey % 4 = 0 THEN 'DS250' END) AS experiment FROM customer",
    "win2_trimmed": f"WITH {_E} SELECT vec_id, 0::INT AS win_idx, round(list_sum(x[21:40]), 6) AS total FROM e",
    "tde3_channels": "WITH e AS (SELECT vec_id, label AS session, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), t AS (SELECT *, unnest(range(4, 64)) AS t FROM e) SELECT session, vec_id, t::INT AS t, unnest(range(2))::INT AS place, unnest([round(x[t + 1], 6), round(x[t - 3], 6)]) AS x FROM t",
    "f13_temporal": f"WITH {_REC}, al AS (SELECT session, trial, win_idx, ci AS dim, sqrt(v1 / v0) AS x FROM hj UNION ALL SELECT session, trial, win_idx, ci + {_NC}, sqrt(v2 / v1) / sqrt(v1 / v0) FROM hj UNION ALL SELECT trial % 5, trial, win_idx, ci + {2 * _NC}, h FROM en) SELECT session, trial, win_idx, dim, round(x, 6) AS x FROM al",
    "qc3_trial_mean": f"WITH {_DFT} SELECT session, channel, f, round(p, 9) AS p FROM ps",
    "qc5_ratios": f"WITH {_QR} SELECT session, round(beta_alpha, 5) AS beta_alpha, round(theta_alpha, 5) AS theta_alpha, round(emg, 5) AS emg FROM ra JOIN em USING (session)",
    "qc8_verdict": f"""WITH {_QR}, lv AS (SELECT session, channel, sqrt(avg(x * x)) AS rms FROM (SELECT session, row % 4 AS channel, x FROM m) GROUP BY ALL), lz AS (SELECT *, abs((rms - avg(rms) OVER w) / stddev_pop(rms) OVER w) > 1.2 AS bad FROM lv WINDOW w AS (PARTITION BY session)), ll AS (SELECT session, avg(rms) AS rms, count(*) FILTER (bad) AS n_bad FROM lz GROUP BY session),
am AS (SELECT label AS session, 100 * avg((t > 0.4)::INT) AS hi, 100 * avg((t > 0.35)::INT) AS lo FROM (SELECT label, greatest(list_max(embedding), -list_min(embedding))::DOUBLE AS t FROM embeddings) GROUP BY ALL),
fl AS (SELECT *, CASE WHEN rms > 0.126 THEN 'red' WHEN rms > 0.1245 THEN 'yellow' ELSE 'green' END AS rf, CASE WHEN emg > 0.35 THEN 'red' WHEN emg > 0.2 THEN 'yellow' ELSE 'green' END AS ef FROM ll JOIN em USING (session) JOIN am USING (session)),
vd AS (SELECT *, rf = 'red' OR ef = 'red' OR hi > 10 AS red, rf = 'yellow' OR ef = 'yellow' OR n_bad > 2 OR lo > 20 AS yel FROM fl)
SELECT session, round(rms, 5) AS rms, round(emg, 5) AS emg, n_bad, rf AS rms_flag, ef AS emg_flag, CASE WHEN red AND (n_bad > 2 OR emg > 0.35) THEN 'Artefacto' WHEN red OR yel THEN 'Atípico' ELSE 'OK' END AS verdict FROM vd""",
    "qc9_reference": f"WITH {_DFT}, mp AS (SELECT session, f, avg(p) AS p FROM ps GROUP BY ALL) SELECT f, round(10 * log10(greatest(avg(p), 1e-30)), 4) AS mean_db, round(10 * log10(greatest(avg(p) - stddev_pop(p), 1e-30)), 4) AS low_db, round(10 * log10(greatest(avg(p) + stddev_pop(p), 1e-30)), 4) AS high_db FROM mp GROUP BY f",
    "dg9_judged": f"""WITH {_K2}, o AS (SELECT dim, skewness(x) AS sk, kurtosis(x) AS ku, stddev_pop(x) AS sd, avg((abs((x - mu) / sqrt(v)) > 3)::INT) AS f FROM m JOIN s0 USING (dim) GROUP BY dim),
g AS (SELECT dim, sk, ku, sd, f, greatest(0, least(1, 1 - least(abs(sk) / 5, 0.35) - least(abs(ku) / 10, 0.3) - least(5 * f, 0.2) - CASE WHEN exp(-k2/2) < 1e-6 THEN 0.15 WHEN exp(-k2/2) < 1e-3 THEN 0.1 WHEN exp(-k2/2) < 0.05 THEN 0.05 ELSE 0 END))::DOUBLE AS score FROM o JOIN k2 USING (dim))
SELECT dim, round(score, 5) AS score, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.65 THEN 'good' WHEN score >= 0.45 THEN 'acceptable' WHEN score >= 0.25 THEN 'poor' ELSE 'very_poor' END AS label, score >= 0.65 AS consistent, sd < 1e-8 AS near_constant,
concat_ws(',', CASE WHEN sd < 1e-8 THEN 'constant' END, CASE WHEN abs(sk) > 2 THEN 'skew' END, CASE WHEN abs(ku) > 5 THEN 'kurtosis' END, CASE WHEN f > 0.05 THEN 'outliers' END, CASE WHEN score < 0.4 THEN 'score' END) AS warnings FROM g""",
    "dg10_report": f"WITH {_M}, q AS (SELECT *, lag(x) OVER (PARTITION BY session, dim ORDER BY row) AS prev FROM m), b AS (SELECT session, dim, CASE WHEN stddev_pop(x) < 1e-12 THEN 0 ELSE corr(x, prev) END AS l, avg(abs(x - prev)) AS s, stddev_pop(x) AS sd FROM q GROUP BY ALL), r AS (SELECT session, avg(l) AS l, stddev_pop(l) AS ls, avg(s) AS s, stddev_pop(s) AS ss, avg(s) / (avg(sd) + 1e-12) AS n FROM b GROUP BY session) SELECT session, round(l, 5) AS lag1_mean, round(ls, 5) AS lag1_sd, round(s, 5) AS step_mean, round(ss, 5) AS step_sd, round(n, 5) AS noise, CASE WHEN l > 0.85 THEN 'very_smooth' WHEN l > 0.65 THEN 'smooth' WHEN l > 0.4 THEN 'moderate' ELSE 'noisy' END AS label FROM r",
    "dg11_report": f"WITH {_M}, q AS (SELECT *, row_number() OVER (PARTITION BY session, dim ORDER BY row) - 1 AS t, count(*) OVER (PARTITION BY session, dim) AS n FROM m), b AS (SELECT session, dim, regr_slope(x, t) AS sl, abs(avg(x) FILTER (t >= n - greatest(5, n // 10)) - avg(x) FILTER (t < greatest(5, n // 10))) AS sh FROM q GROUP BY ALL), r AS (SELECT session, avg(sl) AS sl, stddev_pop(sl) AS ss, avg(sh) AS sh FROM b GROUP BY session) SELECT session, round(sl, 6) AS slope_mean, round(ss, 6) AS slope_sd, round(sh, 6) AS shift_mean, CASE WHEN abs(sl) < 1e-4 AND sh < 0.1 THEN 'stationary' WHEN abs(sl) < 1e-3 THEN 'quasi_stationary' ELSE 'non_stationary' END AS label FROM r",
    "dg12_kpss": f"""WITH {_M}, q AS (SELECT session, dim, row_number() OVER w AS t, count(*) OVER (PARTITION BY session, dim) AS n, x - avg(x) OVER (PARTITION BY session, dim) AS e FROM m WINDOW w AS (PARTITION BY session, dim ORDER BY row)), c AS (SELECT *, sum(e) OVER (PARTITION BY session, dim ORDER BY t) AS s, floor(4 * (n / 100.0::DOUBLE) ** 0.25)::INT AS l FROM q),
v AS (SELECT session, dim, sum(e * e) / any_value(n) AS g, sum(s * s) / any_value(n) ** 2 AS eta FROM c GROUP BY ALL), lg AS (SELECT a.session, a.dim, sum(2 * (1 - (b.t - a.t) / (a.l + 1.0::DOUBLE)) * a.e * b.e) / any_value(a.n) AS x FROM c a JOIN c b ON a.session = b.session AND a.dim = b.dim AND b.t > a.t AND b.t - a.t <= a.l GROUP BY ALL),
k AS (SELECT session, dim, eta / (g + coalesce(x, 0)) AS k FROM v LEFT JOIN lg USING (session, dim)) SELECT session, dim, round(k, 5) AS kpss, round(CASE WHEN k <= 0.347 THEN 0.1 WHEN k <= 0.463 THEN 0.1 - (k - 0.347) / 0.116 * 0.05 WHEN k <= 0.574 THEN 0.05 - (k - 0.463) / 0.111 * 0.025 WHEN k <= 0.739 THEN 0.025 - (k - 0.574) / 0.165 * 0.015 ELSE 0.01 END::DOUBLE, 5) AS p FROM k""",
    "dg15_redundant": f"WITH {_M}, c AS (SELECT a.dim AS i, b.dim AS j, corr(a.x, b.x) AS r FROM m a JOIN m b ON a.row = b.row AND a.dim < b.dim GROUP BY ALL) SELECT i, j, round(r, 5) AS r, CASE WHEN abs(r) >= 0.95 THEN 'extreme' WHEN abs(r) >= 0.9 THEN 'high' ELSE 'moderate' END AS grade FROM c WHERE abs(r) >= 0.05",
    "dg22_separability": f"WITH {_M}, c AS (SELECT session, dim, avg(x) AS v FROM m GROUP BY ALL), q AS (SELECT sqrt(sum((p.v - q.v) ** 2)) AS d FROM c p JOIN c q ON p.dim = q.dim AND p.session < q.session GROUP BY p.session, q.session) SELECT round(avg(d), 5) AS mean, round(stddev_pop(d), 5) AS sd, round(min(d), 5) AS least, round(max(d), 5) AS most, CASE WHEN avg(d) < 0.5 THEN 'subjects_overlap' WHEN avg(d) < 2 THEN 'moderate_subject_separation' ELSE 'strong_subject_separation' END AS label FROM q",
    "m1_standardised": f"WITH {_M}, {_SC} SELECT row, dim, round((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS z FROM m JOIN sc USING (dim)",
    "m8_lengths": "WITH f AS (SELECT user_id AS session, count(*) AS found FROM events GROUP BY ALL), s AS (SELECT c_custkey AS session, c_custkey % 40 + 45 AS stated FROM customer) SELECT session, found, stated FROM f FULL JOIN s USING (session) WHERE found IS DISTINCT FROM stated",
    "m11_geometry": f"WITH {_M}, c AS (SELECT session, dim, avg(x) AS m, var_pop(x) AS v FROM m GROUP BY ALL) SELECT session, round(sqrt(sum(m ** 2)), 6) AS norm, round(avg(v), 6) AS mean_variance, round(max(v), 6) AS most_variance FROM c GROUP BY session",
    "st7_state_table": f"""WITH {_DE}, ks AS (SELECT unnest(range(len(p)))::INT AS state, unnest(p) AS p FROM de), so AS (SELECT state, avg(p) AS soft, count(*) AS total FROM ks GROUP BY state), hd AS (SELECT state, count(*) AS n, avg(list_max(p)) AS c, avg(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-12)))) AS h FROM de GROUP BY state),
tm AS (SELECT state, count(*) FILTER (nxt = state) / count(*)::DOUBLE AS s FROM dl WHERE nxt IS NOT NULL GROUP BY state), r0 AS (SELECT session, state, sum(CASE WHEN prev = state THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY vec_id) AS run FROM dl), rr AS (SELECT state, count(*) * 100.0::DOUBLE AS l FROM r0 GROUP BY session, state, run),
rs AS (SELECT state, avg(l) AS me, median(l) AS md, quantile_cont(l, 0.95) AS p95, count(*) AS n_runs FROM rr GROUP BY state)
SELECT state, round(coalesce(n, 0) / total::DOUBLE, 5) AS fo_hard, round(soft, 5) AS fo_soft, round(coalesce(s, 0), 5) AS self_trans, round(100 / greatest(1 - coalesce(s, 0), 1e-9), 5) AS dwell_analytic, round(coalesce(md, 0), 5) AS dwell_median, round(coalesce(me, 0), 5) AS dwell_mean, round(coalesce(p95, 0), 5) AS dwell_p95, round(c, 5) AS confidence, round(h, 5) AS entropy,
coalesce(n, 0) AS n_windows, coalesce(n_runs, 0) AS n_runs, CASE WHEN coalesce(s, 0) > 0.97 OR 100 / greatest(1 - coalesce(s, 0), 1e-9) > 5000 THEN 'ATRACTOR' ELSE 'OK' END AS flag FROM so LEFT JOIN hd USING (state) LEFT JOIN tm USING (state) LEFT JOIN rs USING (state)""",
    "st8_global_runs": f"WITH {_P}, l AS (SELECT *, lag(state) OVER w AS prev FROM p WINDOW w AS (ORDER BY session, ts, event_id)), r AS (SELECT state, sum(CASE WHEN prev = state THEN 0 ELSE 1 END) OVER (ORDER BY session, ts, event_id) AS run FROM l), k AS (SELECT run, state, count(*) AS length FROM r GROUP BY ALL) SELECT state, length, count(*) AS n FROM k GROUP BY ALL",
    "st18_trial_dwell": f"WITH {_P}, {_TR}, l AS (SELECT *, lag(state) OVER (PARTITION BY session, trial ORDER BY ts, event_id) AS prev FROM tr), v AS (SELECT session, trial, state, count(*) AS n, sum(CASE WHEN prev = state THEN 0 ELSE 1 END)::BIGINT AS r FROM l GROUP BY ALL), k AS (SELECT * FROM (SELECT DISTINCT session, trial FROM v) CROSS JOIN (SELECT DISTINCT state FROM v)) SELECT session, trial, state, round(coalesce(n / r::DOUBLE * 100, 0), 6) AS dwell, coalesce(r, 0) AS n_runs FROM k LEFT JOIN v USING (session, trial, state)",
    "ev2_times": f"WITH {_P}, {_TR} SELECT (-500 + (pos + 1) * 100 + 150)::DOUBLE AS ms, state, round(count(*) / sum(count(*)) OVER (PARTITION BY pos)::DOUBLE, 6) AS p FROM tr GROUP BY pos, state",
    "ev5_courses": f"WITH {_P}, {_TR}, n AS (SELECT session % 2 AS k, pos, state, count(*) AS n FROM tr GROUP BY ALL), q AS (SELECT k, pos, state, n / sum(n) OVER (PARTITION BY k, pos)::DOUBLE AS p FROM n) SELECT a.state, round(max(abs(a.p - b.p)), 6) AS delta, max(abs(a.p - b.p)) < 0.02 AS robust FROM q a JOIN q b ON a.k = 0 AND b.k = 1 AND a.pos = b.pos AND a.state = b.state GROUP BY a.state",
    "stat5_health": f"{_HEALTH} SELECT item, grade, round(value, 5) AS value FROM he",
    "stat5_fitness": f"{_HEALTH} SELECT count(*) FILTER (grade = 'ok') AS ok, count(*) FILTER (grade = 'warning') AS warning, count(*) FILTER (grade = 'critical') AS critical, CASE WHEN count(*) FILTER (grade = 'critical') > 0 THEN 'correct first' WHEN count(*) FILTER (grade = 'warning') <= 1 THEN 'report' ELSE 'acceptable' END AS verdict FROM he",
    "cmp3_between_models": f"{_TWO} SELECT i, j, round(cosine, 5) AS cosine, round(distance, 5) AS distance FROM lk",
    "cmp4_assignment": f"{_TWO}, t AS (SELECT a.j AS j0, b.j AS j1, c.j AS j2, d.j AS j3, a.cosine AS c0, b.cosine AS c1, c.cosine AS c2, d.cosine AS c3 FROM lk a, lk b, lk c, lk d WHERE a.i = 0 AND b.i = 1 AND c.i = 2 AND d.i = 3 AND len(list_distinct([a.j, b.j, c.j, d.j])) = 4 ORDER BY c0 + c1 + c2 + c3 DESC LIMIT 1) SELECT unnest(range(4))::INT AS i, unnest([j0, j1, j2, j3]) AS j, round(unnest([c0, c1, c2, c3]), 5) AS cosine, true AS matched FROM t",
    "cmp5_profile_table": f"WITH {_M}, {_SC}, p AS (SELECT session AS state, dim, avg((x - mu) / sd) AS z FROM m JOIN sc USING (dim) GROUP BY ALL), l AS (SELECT dim // 16 AS f, quantile_cont(abs(z), 0.98) AS l FROM p GROUP BY ALL) SELECT state, 'feature' || (dim // 16) AS feature, '0' AS part, 'c' || (dim % 16) AS channel, round(z, 5) AS z, round(l, 5) AS \"limit\" FROM p JOIN l ON dim // 16 = f",
    "cmp6_leaderboard": f"{_A}, {_P2S}, {_FO2}, {_summary_sql('events', 'p', 'fo')}, {_summary_sql('parity', 'p2', 'fo2')}, u AS (SELECT * FROM s_p UNION ALL SELECT * FROM s_p2) SELECT experiment, k, n_sessions, n_absorbing, score, round(fo_min, 6) AS fo_min, round(fo_max, 6) AS fo_max, round(dwell_max, 6) AS dwell_max, round(confidence, 6) AS confidence, CASE score WHEN 4 THEN 'REPORTAR' WHEN 3 THEN 'ACEPTABLE' ELSE 'REVISAR' END AS verdict, round(100 * n_absorbing / n_sessions::DOUBLE, 6) AS pct_absorbing, row_number() OVER (ORDER BY score DESC, k, experiment)::INT AS place FROM u",
    "cmp7_methods": f"{_A}, {_P2S}, {_FO2}, u AS (SELECT 'events' AS method, * FROM fo UNION ALL SELECT 'parity', * FROM fo2) SELECT method, {CONDITION} AS cond, c_mktsegment AS grp, state, round(avg(fo), 6) AS mean, round(stddev_samp(fo) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM u JOIN customer ON c_custkey = session GROUP BY ALL",
    "cmp9_raw_likeness": f"WITH {_M}, c AS (SELECT session, dim, avg(x) AS z FROM m GROUP BY ALL) SELECT a.session AS i, b.session AS j, round(sum(a.z * b.z) / sqrt(sum(a.z ** 2) * sum(b.z ** 2)), 5) AS cosine, round(sqrt(sum((a.z - b.z) ** 2)), 5) AS distance FROM c a JOIN c b ON a.dim = b.dim AND a.session <> b.session GROUP BY ALL",
    "abs1_profile": f"WITH {_DE}, {_DO}, {_SC}, z AS (SELECT session, 'feature' || (dim // 16) AS kind, (x - mu) / sd AS z FROM m JOIN sc USING (dim)) SELECT session, kind, round(avg(z), 5) AS z FROM z WHERE session IN (SELECT session FROM dab) GROUP BY ALL UNION ALL SELECT NULL, kind, round(avg(z), 5) FROM z WHERE session NOT IN (SELECT session FROM dab) GROUP BY kind",
    "abs4_table": f"""WITH {_DE}, {_DO}, mo AS (SELECT session, count(*) FILTER (prev <> state) AS n_transitions FROM dl GROUP BY session), dd AS (SELECT session, row, state, sqrt(q) AS d FROM dq), bd AS (SELECT session, state, avg(d) AS me FROM dd GROUP BY ALL),
zd AS (SELECT a.session, a.state, (any_value(a.me) - avg(o.me)) / (stddev_pop(o.me) + 1e-9) AS z FROM bd a JOIN bd o ON a.state = o.state AND a.session <> o.session GROUP BY ALL), su AS (SELECT session, state, 100 * avg((p > 0.3)::INT) AS above FROM (SELECT session, unnest(range(len(p)))::INT AS state, unnest(p) AS p FROM de) GROUP BY ALL)
SELECT dab.session, dab.state, round(fo, 4) AS fo, n_transitions, round(z, 4) AS z_distance, round(above, 4) AS above FROM dab JOIN mo USING (session) LEFT JOIN zd USING (session, state) LEFT JOIN su USING (session, state)""",
    "top_balanced": f"{_A}, b AS (SELECT session, stddev_pop(fo) AS s, max(fo) AS m, count(*) FILTER (fo > 0) AS n_states FROM fo GROUP BY session) SELECT session, round(s, 6) AS spread, round(m, 6) AS most, n_states FROM b WHERE m <= 0.95 ORDER BY round(s, 9), session LIMIT 5",
    "stream_states": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type AS state, count(*) AS n FROM events GROUP BY ALL",
    "u6_functions": f"WITH {_M}, a AS (SELECT row, x, x - lag(x) OVER (PARTITION BY row ORDER BY dim) AS d FROM m) SELECT row AS vec_id, round(sqrt(var_pop(d) / var_pop(x)), 6) AS mobility FROM a GROUP BY row",
    "src7_labels": f"WITH {_C} SELECT lower(name) AS session, CASE WHEN c_custkey % 4 <> 0 THEN cond ELSE 'UNKNOWN' END AS condition, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE 'UNKNOWN' END AS grp FROM c",
    "snk2_features": f"WITH {_M} SELECT row, session, dim, round(x, 6) AS x FROM m",
    "snk9_results": f"{_A} SELECT state, round(avg(length * 100.0::DOUBLE), 4) AS mean, round(quantile_cont(length * 100.0::DOUBLE, 0.5), 4) AS median, round(quantile_cont(length * 100.0::DOUBLE, 0.95), 4) AS p95, count(*) AS n_runs, sum(length)::BIGINT AS n_windows FROM r GROUP BY state",
    "snk13_experiments": f"{_A}, {_P2S}, {_FO2} SELECT 'events' AS experiment, state, count(*) AS n, round(avg(round(fo, 6)), 5) AS fo FROM fo GROUP BY state UNION ALL SELECT 'parity', state, count(*), round(avg(round(fo, 6)), 5) FROM fo2 GROUP BY state",
    "snk15_report": f"WITH {_M}, q AS (SELECT dim, round(avg(x), 6) AS a, round(stddev_pop(x), 6) AS b FROM m GROUP BY dim) SELECT dim, length(concat_ws(chr(10), '# dimension ' || dim, chr(10) || '## distribution' || chr(10), '- **mean**: ' || printf('%.4f', a), '- **sd**: ' || printf('%.4f', b)))::INT AS n_chars, '# dimension ' || dim AS title FROM q",
    "snk16_split": "SELECT DISTINCT c_custkey, ('0x' || left(md5('42:' || c_custkey), 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < 0.2 AS test FROM customer",
}
