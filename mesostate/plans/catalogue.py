"""Registered queries of the library's own operators, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.operators import matrices, signals, states

STEP_SEC = 0.1
SCOPE, ORDER = ["session"], ["ts", "event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "event_id", F.col("event_type").alias("state"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("session"), F.col("embedding").cast("array<double>").alias("samples"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs(spark, sf_dir).select(F.col("vec_id").alias("row"), "session", F.posexplode("samples").alias("dim", "x"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(*SCOPE).orderBy(*ORDER)) - 1
    return path(spark, sf_dir).withColumn("trial", F.floor(rn / 9)).withColumn("pos", rn % 9)


def dwell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy, dwell and transition rate of each session and state (ST4)."""
    return rounded(states.summary(path(spark, sf_dir), SCOPE, ORDER, STEP_SEC), "fo", "dwell_sec", "rate_hz")


def _st6(s, d):
    return rounded(dwell_summary(s, d).groupBy("state").agg(F.avg("fo").alias("fo"), F.avg("dwell_sec").alias("dwell_sec"), F.avg("rate_hz").alias("rate_hz")), "fo", "dwell_sec", "rate_hz", digits=4)


def _st20(s, d):
    """Trial metrics, averaged by session and group, in long form (ST20, P6)."""
    by_trial = states.transitions(trials(s, d), ["session", "trial"], ORDER, STEP_SEC)
    groups = table(s, d, "customer").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("grp"))
    return rounded(states.metric_means(by_trial.join(groups, "session"), ["session", "grp"], ["rate_hz", "n_transitions", "n_windows"]), "value")


def _ev(s, d):
    """Both conditions, and each group in both."""
    segments = table(s, d, "customer").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("grp"), F.when(F.col("c_custkey") % 2 == 0, "GO").otherwise("NOGO").alias("cond"))
    return states.evoked(trials(s, d).withColumn("pos", F.col("pos").cast("int")).join(segments, "session"), ["session", "trial"], "pos", [["cond"], ["grp", "cond"]])


def _st12(s, d):
    segments = table(s, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("grp"))
    return rounded(states.occupancy(path(s, d), SCOPE).join(segments, "session", "left").withColumn("grp", F.coalesce("grp", F.lit("UNKNOWN"))), "fo")


def _windows(s, d):
    return signals.sliding_windows(epochs(s, d), 16, 8, 1).select("vec_id", "win_idx", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def _tde(s, d):
    return signals.embed(epochs(s, d), 2, 3).select("vec_id", "t", *[F.round(F.col("x")[k], 6).alias(f"x{k}") for k in range(3)])


def _hjorth(s, d):
    return epochs(s, d).select("vec_id", signals.hjorth(F.col("samples")).alias("h")).select("vec_id", F.round("h.mobility", 6).alias("mobility"), F.round("h.complexity", 6).alias("complexity"))


def _entropy(s, d):
    return epochs(s, d).select("vec_id", F.round(signals.histogram_entropy(F.col("samples")), 6).alias("entropy"))


def _car(s, d):
    return rounded(signals.common_average(matrix(s, d), ["row"]), "x").select("row", "dim", "x")


def thirds(s, d):
    """Mean magnitude of the three thirds of all samples, as stand-ins for three bands that SQL can make too."""
    mean = lambda at, n: (F.aggregate(F.slice("samples", at, n), F.lit(0.0), lambda t, v: t + F.abs(v)) / n)
    return epochs(s, d).select("vec_id", mean(1, 21).alias("a"), mean(22, 21).alias("t"), mean(43, 22).alias("b"))


def _bands(s, d):
    p = thirds(s, d).select("vec_id", signals.relative_power(F.col("a"), F.col("t"), F.col("b")).alias("p"), F.round(signals.asymmetry(F.col("a"), F.col("b")), 6).alias("asymmetry"))
    return p.select("vec_id", *[F.round(f"p.{k}", 6).alias(k) for k in ("alpha", "theta", "beta")], "asymmetry")


def _mw(s, d):
    fo = states.transitions(path(s, d), SCOPE, ORDER, STEP_SEC)
    groups = table(s, d, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("session"), (F.col("c_mktsegment") == "BUILDING").alias("side"))
    return rounded(rounded(states_values(fo.join(groups, "session")), "u", "z"), "p", digits=4)


def states_values(joined: DataFrame) -> DataFrame:
    return matrices.mann_whitney(joined, "side", "n_transitions")


QUERIES = {
    "state_dwell": dwell_summary,
    "st1_occupancy": lambda s, d: rounded(states.occupancy(path(s, d), SCOPE), "fo"),
    "st2_runs": lambda s, d: states.runs(path(s, d), SCOPE, ORDER),
    "st5_transitions": lambda s, d: rounded(states.transitions(path(s, d), SCOPE, ORDER, STEP_SEC), "rate_hz"),
    "st6_global_summary": _st6,
    "st12_occupancy_labelled": _st12,
    "st16_transition_matrix": lambda s, d: rounded(states.transition_matrix(path(s, d), SCOPE, ORDER), "p"),
    "st16_row_entropy": lambda s, d: rounded(states.row_entropy(states.transition_matrix(path(s, d), SCOPE, ORDER)), "entropy"),
    "st15_off_diagonal": lambda s, d: rounded(states.off_diagonal(states.transition_matrix(path(s, d), SCOPE, ORDER)), "p"),
    "st17_dwell_histogram": lambda s, d: rounded(states.dwell_histogram(states.runs(path(s, d), SCOPE, ORDER)), "pct_1", "pct_over_10"),
    "st20_trial_rates": _st20,
    "ev1_evoked": lambda s, d: rounded(_ev(s, d), "p"),
    "ev3_peak": lambda s, d: rounded(states.peak(rounded(_ev(s, d), "p", digits=9), ["grp", "cond"], "pos"), "p"),
    "win1_windows": _windows,
    "tde1_embedding": _tde,
    "f1_hjorth": _hjorth,
    "f3_entropy": _entropy,
    "pre1_common_average": _car,
    "f7_bands": _bands,
    "m1_scaler": lambda s, d: rounded(matrices.scaler(matrix(s, d)), "mean", "scale"),
    "dg3_distribution": lambda s, d: rounded(matrices.distribution(matrix(s, d)), "mean", "sd", "median", "lo", "hi", "p01", "p99", "skew", "kurt", digits=5),
    "dg6_outliers": lambda s, d: rounded(matrices.outliers(matrix(s, d)), "share"),
    "dg15_redundancy": lambda s, d: rounded(matrices.correlations(epochs(s, d), "samples"), "r"),
    "dg22_centroids": lambda s, d: rounded(matrices.centroid_distances(matrix(s, d), "session"), "distance"),
    "dg23_centring": lambda s, d: rounded(matrices.centring_impact(matrix(s, d), "session"), "impact"),
    "stat1_mann_whitney": _mw,
}

_P = "p AS (SELECT user_id AS session, ts, event_id, event_type AS state FROM events)"
_G = "g AS (SELECT *, lag(state) OVER (PARTITION BY session ORDER BY ts, event_id) AS prev, lead(state) OVER (PARTITION BY session ORDER BY ts, event_id) AS nxt FROM p)"
_R = "r0 AS (SELECT session, state, sum(CASE WHEN prev = state THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY ts, event_id) AS run FROM g), r AS (SELECT session, run::BIGINT AS run, state, count(*) AS length FROM r0 GROUP BY ALL)"
_FO = "n AS (SELECT session, count(*) AS n FROM p GROUP BY session), fo AS (SELECT n.session, s.state, count(p.event_id) / n.n::DOUBLE AS fo FROM n CROSS JOIN (SELECT DISTINCT state FROM p) s LEFT JOIN p ON p.session = n.session AND p.state = s.state GROUP BY n.session, s.state, n.n)"
_T = "t AS (SELECT session, count(*) FILTER (prev <> state) AS n_transitions, count(*) AS n_windows, count(*) FILTER (prev <> state) / (count(*) * 0.1::DOUBLE) AS rate_hz FROM g GROUP BY session)"
_D = "dw AS (SELECT session, state, avg(length) * 0.1::DOUBLE AS dwell_sec, count(*) AS n_runs FROM r GROUP BY ALL)"
_A = f"WITH {_P}, {_G}, {_R}, {_FO}, {_T}, {_D}"
_TR = "tr0 AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) - 1 AS rn FROM p), tr AS (SELECT session, ts, event_id, state, rn // 9 AS trial, rn % 9 AS pos FROM tr0)"
_SD = "sd AS (SELECT session, state, round(fo, 6) AS fo, round(dwell_sec, 6) AS dwell_sec, n_runs, n_transitions, n_windows, round(rate_hz, 6) AS rate_hz FROM fo LEFT JOIN dw USING (session, state) JOIN t USING (session))"
_M = "m AS (SELECT vec_id AS row, label AS session, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_MATRIX = "SELECT state AS i, nxt AS j, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY state)::DOUBLE AS p FROM g WHERE nxt IS NOT NULL {} GROUP BY state, nxt"
_EV = f"""WITH {_P}, {_TR}, len AS (SELECT session, trial, count(*) AS n FROM tr GROUP BY ALL), modal AS (SELECT n FROM len GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1),
lb AS (SELECT pos::INT AS pos, state, c_mktsegment AS grp, CASE WHEN c_custkey % 2 = 0 THEN 'GO' ELSE 'NOGO' END AS cond FROM tr JOIN len USING (session, trial) JOIN modal USING (n) JOIN customer ON c_custkey = session),
ev0 AS (SELECT cond, NULL::VARCHAR AS grp, pos, state, count(*) AS k FROM lb GROUP BY cond, pos, state UNION ALL SELECT cond, grp, pos, state, count(*) FROM lb GROUP BY cond, grp, pos, state),
ky AS (SELECT DISTINCT cond, grp, pos FROM ev0), es AS (SELECT DISTINCT state FROM ev0),
ev AS (SELECT ky.cond, ky.grp, ky.pos, es.state, coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY ky.cond, ky.grp, ky.pos)::DOUBLE AS p FROM ky CROSS JOIN es LEFT JOIN ev0 ON ev0.cond = ky.cond AND ev0.grp IS NOT DISTINCT FROM ky.grp AND ev0.pos = ky.pos AND ev0.state = es.state)"""
_E = "e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
_THIRDS = "th AS (SELECT vec_id, list_sum(list_transform(x[1:21], lambda v: abs(v))) / 21 AS a, list_sum(list_transform(x[22:42], lambda v: abs(v))) / 21 AS t, list_sum(list_transform(x[43:64], lambda v: abs(v))) / 22 AS b FROM e)"

SQL = {
    "state_dwell": f"{_A}, {_SD} SELECT * FROM sd",
    "st1_occupancy": f"{_A} SELECT session, state, round(fo, 6) AS fo FROM fo",
    "st2_runs": f"{_A} SELECT * FROM r",
    "st5_transitions": f"{_A} SELECT session, n_transitions, n_windows, round(rate_hz, 6) AS rate_hz FROM t",
    "st6_global_summary": f"{_A}, {_SD} SELECT state, round(avg(fo), 4) AS fo, round(avg(dwell_sec), 4) AS dwell_sec, round(avg(rate_hz), 4) AS rate_hz FROM sd GROUP BY state",
    "st12_occupancy_labelled": f"{_A} SELECT session, state, round(fo, 6) AS fo, coalesce(c_mktsegment, 'UNKNOWN') AS grp FROM fo LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON c_custkey = session",
    "st16_transition_matrix": f"{_A} SELECT i, j, n, round(p, 6) AS p FROM ({_MATRIX.format('')})",
    "st16_row_entropy": f"{_A} SELECT i, round(-sum(p * ln(p)), 6) AS entropy FROM ({_MATRIX.format('')}) GROUP BY i",
    "st15_off_diagonal": f"{_A}, sx AS (SELECT DISTINCT state FROM p), mv AS (SELECT state AS i, nxt AS j, count(*) AS n FROM g WHERE state <> nxt GROUP BY ALL), gr AS (SELECT a.state AS i, b.state AS j, coalesce(n, 0) AS n FROM sx a CROSS JOIN sx b LEFT JOIN mv ON mv.i = a.state AND mv.j = b.state), q AS (SELECT i, j, n, sum(n) OVER (PARTITION BY i) AS t FROM gr) SELECT i, j, round(CASE WHEN t > 0 THEN n / t::DOUBLE ELSE 0 END, 6) AS p FROM q",
    "st17_dwell_histogram": f"{_A} SELECT state, count(*) FILTER (length = 1) AS n_1, count(*) FILTER (length = 2) AS n_2, count(*) FILTER (length BETWEEN 3 AND 5) AS n_3_5, count(*) FILTER (length BETWEEN 6 AND 10) AS n_6_10, count(*) FILTER (length > 10) AS n_over_10, quantile_cont(length, 0.25) AS p25, quantile_cont(length, 0.75) AS p75, quantile_cont(length, 0.95) AS p95, round(100 * avg((length = 1)::INT), 6) AS pct_1, round(100 * avg((length > 10)::INT), 6) AS pct_over_10 FROM r GROUP BY state",
    "st20_trial_rates": f"WITH {_P}, {_TR}, g AS (SELECT *, lag(state) OVER (PARTITION BY session, trial ORDER BY ts, event_id) AS prev FROM tr), x AS (SELECT session, trial, count(*) FILTER (prev <> state) AS c, count(*) AS n FROM g GROUP BY ALL), y AS (SELECT session, c_mktsegment AS grp, avg(c / (n * 0.1::DOUBLE)) AS rate_hz, avg(c)::DOUBLE AS n_transitions, avg(n)::DOUBLE AS n_windows FROM x JOIN customer ON c_custkey = session GROUP BY ALL) SELECT session, grp, metric, round(value, 6) AS value FROM y UNPIVOT (value FOR metric IN (rate_hz, n_transitions, n_windows))",
    "ev1_evoked": f"{_EV} SELECT cond, grp, pos, state, round(p, 6) AS p FROM ev",
    "ev3_peak": f"{_EV} SELECT cond, grp, pos, state, round(p, 6) AS p FROM ev QUALIFY row_number() OVER (PARTITION BY cond, grp, state ORDER BY round(p, 9) DESC, pos) = 1",
    "win1_windows": f"WITH {_E}, w AS (SELECT vec_id, x, unnest(range(1, 6)) AS i FROM e) SELECT vec_id, (i - 1)::INT AS win_idx, round(list_sum(x[i * 8 + 1 : i * 8 + 16]), 6) AS total FROM w",
    "tde1_embedding": f"WITH {_E}, w AS (SELECT vec_id, x, unnest(range(6, 64)) AS t FROM e) SELECT vec_id, t::INT AS t, round(x[t + 1], 6) AS x0, round(x[t - 2], 6) AS x1, round(x[t - 5], 6) AS x2 FROM w",
    "f1_hjorth": f"WITH {_M}, a AS (SELECT row, dim, x, x - lag(x) OVER (PARTITION BY row ORDER BY dim) AS d FROM m), b AS (SELECT *, d - lag(d) OVER (PARTITION BY row ORDER BY dim) AS dd FROM a), v AS (SELECT row, var_pop(x) AS v0, var_pop(d) AS v1, var_pop(dd) AS v2 FROM b GROUP BY row) SELECT row AS vec_id, round(sqrt(v1 / v0), 6) AS mobility, round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) AS complexity FROM v",
    "f3_entropy": f"WITH {_M}, r AS (SELECT row, x, min(x) OVER (PARTITION BY row) AS lo, max(x) OVER (PARTITION BY row) AS hi FROM m), b AS (SELECT row, least(floor((x - lo) / (hi - lo) * 10), 9) AS b, count(*) / 64.0::DOUBLE AS p FROM r GROUP BY ALL) SELECT row AS vec_id, round(-sum(p * log2(p)), 6) AS entropy FROM b GROUP BY row",
    "pre1_common_average": f"WITH {_M} SELECT row, dim, round(x - avg(x) OVER (PARTITION BY row), 6) AS x FROM m",
    "f7_bands": f"WITH {_E}, {_THIRDS} SELECT vec_id, round(a / (a + t + b + 1e-10), 6) AS alpha, round(t / (a + t + b + 1e-10), 6) AS theta, round(b / (a + t + b + 1e-10), 6) AS beta, round((b - a) / (b + a + 1e-10), 6) AS asymmetry FROM th",
    "m1_scaler": f"WITH {_M} SELECT dim, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END, 6) AS scale FROM m GROUP BY dim",
    "dg3_distribution": f"WITH {_M} SELECT dim, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS sd, round(median(x), 5) AS median, round(min(x), 5) AS lo, round(max(x), 5) AS hi, round(quantile_cont(x, 0.01), 5) AS p01, round(quantile_cont(x, 0.99), 5) AS p99, round(skewness(x), 5) AS skew, round(kurtosis(x), 5) AS kurt FROM m GROUP BY dim",
    "dg6_outliers": f"WITH {_M}, s AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM m GROUP BY dim) SELECT dim, round(avg((abs((x - mu) / sd) > 3)::INT), 6) AS share FROM m JOIN s USING (dim) GROUP BY dim",
    "dg15_redundancy": f"WITH {_M} SELECT a.dim AS i, b.dim AS j, round(corr(a.x, b.x), 6) AS r FROM m a JOIN m b ON a.row = b.row AND a.dim < b.dim GROUP BY ALL",
    "dg22_centroids": f"WITH {_M}, c AS (SELECT session, dim, avg(x) AS v FROM m GROUP BY ALL) SELECT p.session AS a, q.session AS b, round(sqrt(sum((p.v - q.v) ** 2)), 6) AS distance FROM c p JOIN c q ON p.dim = q.dim AND p.session < q.session GROUP BY ALL",
    "dg23_centring": f"WITH {_M}, c AS (SELECT dim, x, x - avg(x) OVER (PARTITION BY session, dim) AS c FROM m), q AS (SELECT dim, 1 - var_pop(c) / (var_pop(x) + 1e-12) AS r FROM c GROUP BY dim) SELECT dim, round(r, 6) AS impact, CASE WHEN r < 0.1 THEN 'minimal_subject_bias' WHEN r < 0.3 THEN 'moderate_subject_bias' ELSE 'strong_subject_bias' END AS label FROM q",
    # p by the rational approximation of the error function with an error under 1.5e-7
    "stat1_mann_whitney": f"""{_A}, v AS (SELECT n_transitions AS x, c_mktsegment = 'BUILDING' AS side FROM t JOIN customer ON c_custkey = session WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
k AS (SELECT x, side, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM v), ti AS (SELECT sum(n ** 3 - n)::DOUBLE AS ties FROM (SELECT count(*) AS n FROM v GROUP BY x)),
u AS (SELECT (sum(r) FILTER (side) - count(*) FILTER (side) * (count(*) FILTER (side) + 1) / 2.0)::DOUBLE AS u, (count(*) FILTER (side))::BIGINT AS n1, (count(*) FILTER (NOT side))::BIGINT AS n2 FROM k),
z AS (SELECT *, greatest(abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5, 0) / sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE)))) AS z FROM u CROSS JOIN ti),
e AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z / sqrt(2)) AS s FROM z)
SELECT round(u, 6) AS u, n1, n2, round(z, 6) AS z, round(((((1.061405429::DOUBLE * s - 1.453152027::DOUBLE) * s + 1.421413741::DOUBLE) * s - 0.284496736::DOUBLE) * s + 0.254829592::DOUBLE) * s * exp(-z * z / 2), 4) AS p FROM e""",
}
