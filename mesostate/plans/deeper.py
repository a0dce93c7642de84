"""Registered queries of clusters, many fits, order statistics, stability, tests, streams and recordings, and their SQL for DuckDB.

Fits and clusters have no SQL; tests hold them against single fits, exhaustive starts and plain forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesostate import streaming
from mesostate.operators import clustering, comparison, complexity, diagnostics, kernels, lags, matrices, models, orderstats, stability, statequality, states
from mesostate.plans import extended
from mesostate.plans.assembled import RATE, _scores
from mesostate.plans.catalogue import _A, _E, _M, _P, _TR, ORDER, SCOPE, epochs, matrix, path, rounded, table, trials
from mesostate.sources import recordings, writers
from mesostate.storage import checkpoint, scratch

SIDES = ("BUILDING", "MACHINERY")
#: Relabellings of the registered tests; all are drawn by hash, which SQL does too.
REPLICATES, SEED = 99, 42
#: What metadata say of the suitability of a dimension, in turn.
PRIORS = ("high", "medium", "low", None)
GAP_HOURS = 30
#: Steps of the fits of these queries at most; a fit that has not converged by then says so.
STEPS = 60


def _clusters(s, d) -> DataFrame:
    """Windows with the nearest of four centres, and the cost of all."""
    rows = checkpoint(_scores(s, d))
    best = min(clustering.k_means(rows, 4, [1, 2, 3]), key=lambda c: c.cost)
    return clustering.assigned(rows, best.points).select("session", "vec_id", "cluster", F.lit(best.cost).alias("cost"))


def _restarts(s, d) -> DataFrame:
    rows = checkpoint(_scores(s, d))
    return models.restarted(rows, ["session", "trial"], "vec_id", 3, [1, 2, 3, 4], n_iter=STEPS)[0]


def _fitted_states(s, d) -> DataFrame:
    """The table of states of a fitted model (M9)."""
    rows = checkpoint(_scores(s, d))
    fitted = models.fit_hmm(rows, ["session", "trial"], "vec_id", 3, start="clusters", restarts=2, n_iter=STEPS)
    found = checkpoint(fitted.decode(rows, ["session", "trial"], "vec_id"))
    scope = ["session", "trial"]
    return statequality.state_table(found, states.runs(found, scope, ["vec_id"]), states.transition_matrix(found, scope, ["vec_id"]), 100.0)


def _criteria(s, d) -> DataFrame:
    """Criteria of models of two and three states of every kind of covariance, all fitted at once."""
    rows = checkpoint(_scores(s, d))
    n, _, moments = models.co_moments(rows)
    centres = {k: clustering.k_means(rows, k, [SEED])[0].points for k in (2, 3)}
    starts = [models.starting(centres[k], moments / n, kind) for k in centres for kind in ("diag", "full", "tied")]
    fits = models.fit_many(rows, ["session", "trial"], "vec_id", starts, n_iter=STEPS)
    table_ = [(len(m.mean), m.mean.shape[1], n, m.covariance, m.history[-1]) for m in fits]
    return models.bic_table(s.createDataFrame(table_, "k int, d int, n long, covariance string, log_likelihood double"))


def _filter(s, d) -> DataFrame:
    """Probabilities of states given the windows so far (no later ones)."""
    rows = checkpoint(_scores(s, d).withColumn("sequence", F.concat_ws("-", "session", "trial")))
    fitted = models.fit_hmm(rows, ["sequence"], "vec_id", 2, n_iter=20, covariance="tied", start="clusters")
    return streaming.filtered(rows, fitted, "sequence", "vec_id")


def _sessions(s, d) -> DataFrame:
    events = path(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    found = streaming.state_sessions(events, "session", "ts", f"{GAP_HOURS} hours", "1 day", extended.EVENT_TYPES)
    return found.select("session", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", *[f"n_{k}" for k in extended.EVENT_TYPES])


def _stream_sessions(s, d) -> DataFrame:
    """The sessions of the events read as a stream that has ended: those that a later row has closed."""
    out, source = scratch(s, "sessions"), f"{d}/events.parquet"
    events = s.readStream.schema(s.read.parquet(source).schema).parquet(f"{d}/events*.parquet")
    given = events.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("state"))
    streaming.appended(streaming.state_sessions(given, "session", "ts", f"{GAP_HOURS} hours", "1 hour", extended.EVENT_TYPES), out, scratch(s, "sessions-state"))
    found = s.read.parquet(out)
    return found.select("session", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", *[f"n_{k}" for k in extended.EVENT_TYPES])


def _stream_filter(s, d) -> DataFrame:
    """Probabilities of two states of the events' values, each given once its row has come, by a model that is fitted on the table."""
    name, out = "spark.sql.streaming.stateStore.providerClass", scratch(s, "filtered")
    columns = [F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.array("value").alias("x")]
    known = table(s, d, "events")
    fitted = models.fit_hmm(known.where("value IS NOT NULL").select(*columns), ["session"], "ts", 2, n_iter=10)
    before = s.conf.get(name)
    s.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = s.readStream.schema(known.schema).parquet(f"{d}/events*.parquet")
        streaming.appended(streaming.online_filter(events.where("value IS NOT NULL").select(*columns), fitted, "session", "ts", "1 day", 10**12), out, scratch(s, "filter-state"))
    finally:
        s.conf.set(name, before)
    return s.read.parquet(out)


def _quantiles(s, d) -> DataFrame:
    found = orderstats.quantiles(matrix(s, d), ["session", "dim"], "x", {"p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95})
    return rounded(found, "p05", "p25", "p75", "p95")


def _priors(s, d) -> DataFrame:
    """``dg25_suitability`` with what the metadata say of each dimension."""
    q = extended.QUERIES
    steady = q["dg10_smoothness"](s, d).groupBy("dim").agg(F.avg("lag1").alias("lag1"), F.avg("ratio").alias("noise"))
    scores = q["dg8_gaussianity"](s, d).select("dim", F.col("score").alias("gauss")).join(steady, "dim").crossJoin(q["dg21_between_sessions"](s, d).select("fingerprint"))  # one row
    prior = F.element_at(F.array(*[F.lit(p) for p in PRIORS]), (F.col("dim") % len(PRIORS) + 1).cast("int"))
    return rounded(comparison.suitability(scores, prior).select("dim", "suitability", "label", "warnings"), "suitability", digits=4)


def _by_subject(s, d) -> DataFrame:
    """Occupancy of each subject and half of its trials, with its segment."""
    cond = F.when(F.col("trial") % 2 == 0, "GO").otherwise("NOGO")
    fo = states.occupancy(trials(s, d).withColumn("cond", cond), ["session", "cond"])
    return fo.join(table(s, d, "customer").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("grp")), "session")


def _interaction(s, d) -> DataFrame:
    found = stability.interaction(_by_subject(s, d), "session", "grp", "cond", ("GO", "NOGO"), ["state"], "fo", SIDES, replicates=REPLICATES, seed=SEED, most=0)
    return rounded(found, "effect", "p", digits=5)


def _transition_tests(s, d) -> DataFrame:
    groups = table(s, d, "customer").where(F.col("c_mktsegment").isin(*SIDES)).select(F.col("c_custkey").alias("session"), (F.col("c_mktsegment") == SIDES[0]).alias("side"))
    shares = stability.transition_shares(path(s, d).join(groups.select("session"), "session", "left_semi"), "session", SCOPE, ORDER)
    found = stability.relabelling_test(shares.join(groups, "session"), "session", "side", ["i", "j"], "p", replicates=REPLICATES, seed=SEED, most=0)
    return rounded(stability.step_up(rounded(found, "p", digits=9)).select("i", "j", "effect", "p", "q"), "effect", "p", "q", digits=5)


def _split_half(s, d) -> DataFrame:
    rows = _scores(s, d).withColumn("subject", F.col("trial")).select("subject", "session", "vec_id", "x")
    return stability.split_half(rows, "subject", ["session", "subject"], "vec_id", 2, replicates=50, restarts=2, n_iter=STEPS)


def _text_epochs(s, d) -> DataFrame:
    """Recordings written as text, a file or more a session, and read back as epochs of five steps of three channels (SRC2)."""
    out = scratch(s, "recordings")
    e = epochs(s, d)
    line = F.concat_ws(" ", *[F.col("samples")[k].cast("string") for k in range(4)])
    e.select("session", "vec_id", line.alias("value")).repartition("session").sortWithinPartitions("session", "vec_id").select("session", "value").write.partitionBy("session").text(out)
    found = recordings.text_epochs(s, out, ["Fz", "Cz", "Pz"], 5)
    return found.select(F.regexp_extract("file", "session=(-?[0-9]+)/", 1).cast("int").alias("session"), "trial", "channel", F.transform("samples", lambda v: F.round(v, 6)).alias("samples"))


def _report(s, d) -> DataFrame:
    """The whole report of each dimension (SNK15), from the registered diagnostics."""
    q = extended.QUERIES
    four = lambda df, *columns: df.withColumns({c: F.round(c, 4) + 0.0 for c in columns})
    key = lambda df, *columns: df.select(F.col("dim").alias("feature"), *columns)
    dims = matrix(s, d).select(F.col("dim").alias("feature")).distinct()
    prior = F.element_at(F.array(*[F.lit(p) for p in PRIORS]), (F.col("feature") % len(PRIORS) + 1).cast("int"))
    sections = {
        "Metadata": dims.select("feature", prior.alias("suitability")),
        "Distribution": key(four(matrices.distribution(matrix(s, d)), "mean", "sd", "skew", "kurt"), "mean", "sd", "skew", "kurt"),
        "Temporal Smoothness": key(four(q["dg10_smoothness"](s, d).groupBy("dim").agg(F.avg("lag1").alias("lag1"), F.avg("ratio").alias("noise")), "lag1", "noise"), "lag1", "noise"),
        "Stationarity": key(four(q["dg11_stationarity"](s, d).groupBy("dim").agg(F.avg("slope").alias("slope"), F.avg("shift").alias("shift")), "slope", "shift"), "slope", "shift"),
        "Inter-Subject Variability": dims.crossJoin(four(q["dg21_between_sessions"](s, d), "fingerprint").select("fingerprint", F.col("label").alias("signature"))),  # one row
        "HMM Compatibility": key(_priors(s, d), "suitability", "label", "warnings"),
    }
    strong = matrices.redundant(matrices.correlations(epochs(s, d), "samples"), 0.05).select("i", "j", F.round("r", 3).alias("r"))
    pairs = strong.select(F.col("i").alias("feature"), F.col("j").alias("other"), "r").unionByName(strong.select(F.col("j").alias("feature"), F.col("i").alias("other"), "r"))
    return writers.feature_report(dims, sections, pairs)


QUERIES = {
    "snk15_feature_report": _report,
    "m4_clusters": _clusters,
    "m4_restarts": _restarts,
    "m9_fitted_states": _fitted_states,
    "m10_bic": _criteria,
    "m6_filter": _filter,
    "stream_filter": _stream_filter,
    "stream_sessions": _sessions,
    "stream_sessions_appended": _stream_sessions,
    "dg4_quantiles": _quantiles,
    "qc4_welch_power": lambda s, d: rounded(diagnostics.band_power(epochs(s, d).select("vec_id", F.inline(kernels.welch("samples", RATE))), ["vec_id"], 8.0, 13.0), "power", digits=7),
    "dg12_kpss_auto": lambda s, d: rounded(lags.kpss_auto(matrix(s, d), ["session"], "row"), "kpss", "p", digits=5),
    "dg25_priors": _priors,
    "f14_sample_entropy": lambda s, d: rounded(epochs(s, d).select("vec_id", complexity.sample_entropy(F.col("samples")).alias("entropy")), "entropy", digits=6),
    "design_interaction": _interaction,
    "design_transitions": _transition_tests,
    "design_split_half": _split_half,
    "src2_epochs": _text_epochs,
}

_STATES = ", ".join(f"count(*) FILTER (state = '{k}') AS n_{k}" for k in extended.EVENT_TYPES)
_SESSIONS = f"""WITH {_P}, q AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {GAP_HOURS} HOUR THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, event_id) AS k FROM q), f AS (SELECT session, min(ts) AS a, max(ts) AS b, count(*) AS n, {_STATES} FROM g GROUP BY session, k)"""
_SESSION_ROWS = f"SELECT session, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n, {', '.join(f'n_{k}' for k in extended.EVENT_TYPES)} FROM f"


def _relabelled(values: str, items: str) -> str:
    """Tests by drawn relabelling of ``values(session, side, v)`` and items, as tables ``gp`` (gap of each replicate) and ``te`` (effect and p)."""
    return f"""sj AS (SELECT DISTINCT session, side FROM {values}), nf AS (SELECT count(*) FILTER (side) AS n FROM sj),
hs AS (SELECT b, session, ('0x' || left(md5(concat_ws(':', '{SEED}', b::VARCHAR, session::VARCHAR)), 12))::BIGINT AS u FROM sj CROSS JOIN (SELECT unnest(range(1, {REPLICATES} + 1)) AS b)),
lb AS (SELECT b, session, row_number() OVER (PARTITION BY b ORDER BY u) <= (SELECT n FROM nf) AS side FROM hs UNION ALL SELECT 0, session, side FROM sj),
gp AS (SELECT b, {items}, avg(v) FILTER (lb.side) - avg(v) FILTER (NOT lb.side) AS gap FROM {values} v JOIN lb USING (session) GROUP BY b, {items}),
te AS (SELECT {items}, t.gap AS effect, (count(*) FILTER (abs(g.gap) >= abs(t.gap) - 1e-12) + 1) / (count(g.gap) + 1)::DOUBLE AS p FROM gp g JOIN gp t USING ({items}) WHERE g.b > 0 AND t.b = 0 AND t.gap IS NOT NULL GROUP BY {items}, t.gap)"""


_FOUR = "concat('- **{0}**: ', printf('%.4f', round({0}, 4) + 0.0::DOUBLE))"


def _lines(*names: str) -> str:
    return " || chr(10) || ".join(_FOUR.format(n) for n in names)


_REPORT = f"""WITH {_M}, ds AS (SELECT DISTINCT dim FROM m), di AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS sd, skewness(x) AS skew, kurtosis(x) AS kurt FROM m GROUP BY dim),
sm AS (SELECT dim, avg(lag1) AS lag1, avg(ratio) AS noise FROM ({extended.SQL['dg10_smoothness']}) GROUP BY dim), st AS (SELECT dim, avg(slope) AS slope, avg(shift) AS shift FROM ({extended.SQL['dg11_stationarity']}) GROUP BY dim),
bt AS (SELECT fingerprint, label AS signature FROM ({extended.SQL['dg21_between_sessions']})), co AS (SELECT a.dim AS i, b.dim AS j, corr(a.x, b.x) AS r FROM m a JOIN m b ON a.row = b.row AND a.dim <> b.dim GROUP BY ALL),
pa AS (SELECT i AS dim, string_agg('  - ' || i || ' ↔ ' || j || printf(' (corr=%.3f)', round(r, 3)), chr(10) ORDER BY -abs(round(r, 3)), j) AS pairs FROM co WHERE abs(r) >= 0.05 GROUP BY i)
SELECT ds.dim AS feature, concat_ws(chr(10), '# Feature Diagnostic Report' || chr(10), '## ' || ds.dim || chr(10),
'## Metadata' || chr(10) || chr(10) || '- **suitability**: ' || coalesce(['high', 'medium', 'low', NULL][ds.dim % 4 + 1], '-') || chr(10),
'## Distribution' || chr(10) || chr(10) || {_lines("mean", "sd", "skew", "kurt")} || chr(10), '## Temporal Smoothness' || chr(10) || chr(10) || {_lines("lag1", "noise")} || chr(10),
'## Stationarity' || chr(10) || chr(10) || {_lines("slope", "shift")} || chr(10), '## Redundancy' || chr(10) || chr(10) || coalesce('- **redundant_pairs**:' || chr(10) || pairs, '- **redundant_pairs**: -') || chr(10),
'## Inter-Subject Variability' || chr(10) || chr(10) || {_lines("fingerprint")} || chr(10) || '- **signature**: ' || signature || chr(10),
'## HMM Compatibility' || chr(10) || chr(10) || {_lines("suitability")} || chr(10) || '- **label**: ' || hm.label || chr(10) || '- **warnings**: ' || hm.warnings || chr(10)) AS report
FROM ds JOIN di USING (dim) JOIN sm USING (dim) JOIN st USING (dim) CROSS JOIN bt LEFT JOIN pa USING (dim) JOIN hm USING (dim)"""


SQL = {
    # a session is what a gap of over so many hours ends; a stream gives out those that the watermark has passed
    "stream_sessions": f"{_SESSIONS} {_SESSION_ROWS}",
    "stream_sessions_appended": f"{_SESSIONS} {_SESSION_ROWS} WHERE b + INTERVAL {GAP_HOURS} HOUR <= (SELECT max(ts) FROM p) - INTERVAL 1 HOUR",
    "dg4_quantiles": f"WITH {_M} SELECT session, dim, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.95), 6) AS p95 FROM m GROUP BY session, dim",
    # the spectrum of one window with a raised cosine over all samples, at whole Hertz
    "qc4_welch_power": f"""WITH {_M}, cd AS (SELECT row, dim AS t, (x - avg(x) OVER (PARTITION BY row)) * (0.5 - 0.5 * cos(2 * pi() * dim / 64)) AS w FROM m),
cs AS (SELECT row, k, sum(w * cos(2 * pi() * k * t / 64)) AS c, sum(w * sin(2 * pi() * k * t / 64)) AS s FROM cd CROSS JOIN (SELECT unnest(range(8, 14)) AS k) GROUP BY row, k),
ps AS (SELECT row, k, 2 * (c * c + s * s) / ({RATE} * 24) AS p FROM cs) SELECT a.row AS vec_id, round(sum((a.p + b.p) / 2), 7) AS power FROM ps a JOIN ps b ON a.row = b.row AND b.k = a.k + 1 GROUP BY a.row""",
    "dg12_kpss_auto": f"""WITH {_M}, q AS (SELECT session, dim, row_number() OVER w AS t, count(*) OVER (PARTITION BY session, dim) AS n, x - avg(x) OVER (PARTITION BY session, dim) AS e FROM m WINDOW w AS (PARTITION BY session, dim ORDER BY row)),
c AS MATERIALIZED (SELECT *, sum(e) OVER (PARTITION BY session, dim ORDER BY t) AS s FROM q), v AS (SELECT session, dim, any_value(n) AS n, sum(e * e) AS sq, sum(s * s) AS pt FROM c GROUP BY ALL),
r AS MATERIALIZED (SELECT a.session, a.dim, b.t - a.t AS k, sum(a.e * b.e) AS r FROM c a JOIN c b ON a.session = b.session AND a.dim = b.dim AND b.t > a.t GROUP BY ALL),
f AS (SELECT session, dim, n, sq, pt, sq / n + 2 * sum(r) FILTER (k <= floor(n ** (2 / 9.0::DOUBLE))) / n AS s0, 2 * sum(k * r) FILTER (k <= floor(n ** (2 / 9.0::DOUBLE))) / n AS s1 FROM v JOIN r USING (session, dim) GROUP BY session, dim, n, sq, pt),
l AS (SELECT *, least(floor(1.1447 * ((s1 / s0) ** 2) ** (1 / 3.0::DOUBLE) * n ** (1 / 3.0::DOUBLE))::BIGINT, n - 1) AS lags FROM f),
k AS (SELECT session, dim, lags, pt / n ** 2 / ((sq + 2 * coalesce(sum((1 - k / (lags + 1.0::DOUBLE)) * r) FILTER (k <= lags), 0)) / n) AS k FROM l JOIN r USING (session, dim) GROUP BY session, dim, lags, n, sq, pt)
SELECT session, dim, lags, round(k, 5) AS kpss, round(CASE WHEN k <= 0.347 THEN 0.1 WHEN k <= 0.463 THEN 0.1 - (k - 0.347) / 0.116 * 0.05 WHEN k <= 0.574 THEN 0.05 - (k - 0.463) / 0.111 * 0.025 WHEN k <= 0.739 THEN 0.025 - (k - 0.574) / 0.165 * 0.015 ELSE 0.01 END::DOUBLE, 5) AS p FROM k""",
    "dg25_priors": f"""WITH g AS ({extended.SQL['dg8_gaussianity']}), l AS (SELECT dim, avg(lag1) AS lag1, avg(ratio) AS noise FROM ({extended.SQL['dg10_smoothness']}) GROUP BY dim), f AS ({extended.SQL['dg21_between_sessions']}),
t AS (SELECT dim, g.score AS gauss, greatest(0, least(1, (lag1 + 1) / 2))::DOUBLE * exp(-noise) AS temporal, greatest(0, least(1, 1 - fingerprint))::DOUBLE AS steady FROM g JOIN l USING (dim) CROSS JOIN f),
q AS (SELECT *, 0.4::DOUBLE * gauss + 0.35::DOUBLE * temporal + 0.15::DOUBLE * steady + 0.1::DOUBLE * [0.9, 0.6, 0.3, 0.5][dim % 4 + 1]::DOUBLE AS s FROM t)
SELECT dim, round(s, 4) AS suitability, CASE WHEN s >= 0.8 THEN 'excellent' WHEN s >= 0.65 THEN 'good' WHEN s >= 0.45 THEN 'acceptable' WHEN s >= 0.25 THEN 'poor' ELSE 'very_poor' END AS label,
concat_ws(',', CASE WHEN gauss < 0.4 THEN 'gauss' END, CASE WHEN temporal < 0.35 THEN 'noise' END, CASE WHEN steady < 0.35 THEN 'identity' END) AS warnings FROM q""",
    "f14_sample_entropy": f"""WITH {_E}, w AS (SELECT vec_id, x, 0.2::DOUBLE * list_stddev_pop(x) AS r, unnest(range(1, len(x) - 1)) AS i FROM e), w3 AS (SELECT vec_id, i, r, x[i] AS a, x[i + 1] AS b, x[i + 2] AS c FROM w),
s AS (SELECT p.vec_id, count(*) AS n, count(*) FILTER (abs(p.c - q.c) <= p.r) AS k FROM w3 p JOIN w3 q ON p.vec_id = q.vec_id AND p.i < q.i AND abs(p.a - q.a) <= p.r AND abs(p.b - q.b) <= p.r GROUP BY p.vec_id)
SELECT e.vec_id, round(CASE WHEN k > 0 THEN -ln(k / n::DOUBLE) END, 6) + 0.0 AS entropy FROM e LEFT JOIN s USING (vec_id)""",
    "design_interaction": f"""WITH {_P}, {_TR}, tc AS (SELECT session, state, CASE WHEN trial % 2 = 0 THEN 'GO' ELSE 'NOGO' END AS cond FROM tr), nn AS (SELECT session, cond, count(*) AS n FROM tc GROUP BY ALL),
fo AS (SELECT nn.session, nn.cond, z.state, count(tc.state) / nn.n::DOUBLE AS fo FROM nn CROSS JOIN (SELECT DISTINCT state FROM p) z LEFT JOIN tc ON tc.session = nn.session AND tc.cond = nn.cond AND tc.state = z.state GROUP BY nn.session, nn.cond, z.state, nn.n),
ga AS (SELECT session, c_mktsegment = '{SIDES[0]}' AS side, state, avg(fo) FILTER (cond = 'GO') - avg(fo) FILTER (cond = 'NOGO') AS v FROM fo JOIN customer ON c_custkey = session WHERE c_mktsegment IN {SIDES} GROUP BY ALL),
va AS (SELECT * FROM ga WHERE v IS NOT NULL), {_relabelled("va", "state")} SELECT state, round(effect, 5) AS effect, round(p, 5) AS p FROM te""",
    "design_transitions": f"""{_A}, mv AS (SELECT session, state AS i, nxt AS j, c_mktsegment = '{SIDES[0]}' AS side FROM g JOIN customer ON c_custkey = session WHERE c_mktsegment IN {SIDES} AND nxt IS NOT NULL AND nxt <> state),
lf AS (SELECT session, side, i, count(*) AS total FROM mv GROUP BY ALL), pr AS (SELECT DISTINCT i, j FROM mv), va AS (SELECT lf.session, lf.side, lf.i, pr.j, count(mv.j) / lf.total::DOUBLE AS v FROM lf JOIN pr USING (i) LEFT JOIN mv ON mv.session = lf.session AND mv.i = lf.i AND mv.j = pr.j GROUP BY lf.session, lf.side, lf.i, pr.j, lf.total),
{_relabelled("va", "i, j")}, tp AS (SELECT i, j, effect, round(p, 9) AS p FROM te), rk AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM tp)
SELECT i, j, round(effect, 5) AS effect, round(p, 5) AS p, round(least(1.0::DOUBLE, min(p * m / r::DOUBLE) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) AS q FROM rk""",
    "src2_epochs": """WITH q AS (SELECT label AS session, embedding AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS step FROM embeddings), c AS (SELECT session, step // 5 AS trial, step, unnest(['Fz', 'Cz', 'Pz']) AS channel, unnest([e[1], e[2], e[3]])::DOUBLE AS x FROM q)
SELECT session, trial, channel, list(round(x, 6) ORDER BY step) AS samples FROM c GROUP BY session, trial, channel HAVING count(*) = 5""",
}

# the report reads the suitability of the query before it
SQL["snk15_feature_report"] = _REPORT.replace("SELECT ds.dim AS feature", f", hm AS ({SQL['dg25_priors']}) SELECT ds.dim AS feature", 1)
