"""Registered queries of diagnostics, state quality and models, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesostate.operators import comparison, diagnostics, matrices, models, statequality, states
from mesostate.plans.catalogue import _A, _E, _M, _MATRIX, _P, _THIRDS, _TR, ORDER, SCOPE, STEP_SEC, epochs, matrix, path, rounded, table, thirds, trials

def _shape(s, d) -> DataFrame:
    long = matrix(s, d)
    shape = matrices.distribution(long).select("dim", "skew", "kurt")
    shape = shape.join(matrices.outliers(long).withColumnRenamed("share", "outliers"), "dim").join(diagnostics.normality(long), "dim")
    return rounded(diagnostics.gaussianity(shape).select("dim", "score", "label"), "score", digits=5)


def _steps(s, d) -> DataFrame:
    return states.transition_matrix(path(s, d), SCOPE, ORDER)


def _quality(s, d) -> DataFrame:
    fo = states.occupancy(path(s, d), SCOPE).groupBy("state").agg(F.avg("fo").alias("fo"))
    dwell = statequality.dwell_statistics(states.runs(path(s, d), SCOPE, ORDER), 100.0).select("state", F.col("mean").alias("dwell"))
    sure = _steps(s, d).groupBy(F.col("i").alias("state")).agg(F.max("p").alias("confidence"))
    return statequality.quality(fo.join(dwell, "state").join(sure, "state"))


#: The states of the table ``events``, which its SQL must name.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

#: Deviation of the Gaussians about the sessions' centroids, the states of ``posterior``.
SPREAD = 0.35


def posterior(s, d) -> DataFrame:
    """``vec_id, session, p``: probability of each session's centroid given all dimensions of a row."""
    m = matrix(s, d)
    means = matrices.centroids(m, "session").withColumnRenamed("session", "state")
    return comparison.mixture_posterior(m, means, ["row", "session"], SPREAD).withColumnRenamed("row", "vec_id")


def _soft(s, d) -> DataFrame:
    return rounded(posterior(s, d).select("vec_id", *statequality.soft(F.col("p"))), "entropy", "relative", "confidence", digits=5)


def _wide(s, d) -> DataFrame:
    p = path(s, d)
    names = sorted(r[0] for r in p.select("state").distinct().collect())  # a handful of states
    found = statequality.wide(states.occupancy(p, SCOPE), states.dwell(p, SCOPE, ORDER, STEP_SEC), "session", names)
    return rounded(found, *[f"{m}_{k}" for m in ("fo", "dwell") for k in names])


def _psd(s, d) -> DataFrame:
    return epochs(s, d).select("vec_id", F.posexplode("samples").alias("f", "v")).select("vec_id", F.col("f").cast("double").alias("f"), (F.col("v") * F.col("v")).alias("p"))


def _rows(s, d) -> DataFrame:
    """Windows of all features; 32 neighbouring ones of a label are a sequence."""
    return epochs(s, d).select("session", F.floor(F.col("vec_id") / 32).alias("trial"), "vec_id", F.col("samples").alias("x"))


def _pca(s, d) -> DataFrame:
    rows = epochs(s, d).select("vec_id", F.col("samples").alias("x"))
    return models.principal_components(rows, 0.9).transform(rows).select("vec_id", "pc")


def _hmm(s, d) -> DataFrame:
    rows = _rows(s, d)
    return models.fit_hmm(rows, ["session", "trial"], "vec_id", 3).decode(rows, ["session", "trial"], "vec_id")


QUERIES = {
    "dg5_normality": lambda s, d: rounded(diagnostics.normality(matrix(s, d)), "k2", "p", digits=5),
    "dg8_gaussianity": _shape,
    "dg10_smoothness": lambda s, d: rounded(diagnostics.smoothness(matrix(s, d), ["session"], "row"), "lag1", "step", "ratio", "sd", digits=5),
    "dg11_stationarity": lambda s, d: rounded(diagnostics.stationarity(matrix(s, d), ["session"], "row"), "slope", "shift"),
    "dg21_between_sessions": lambda s, d: rounded(diagnostics.between_sessions(matrix(s, d), "session", ["row", "dim"]), "within", "between", "ratio", "fingerprint", digits=5),
    "pre4_reject": lambda s, d: diagnostics.reject_artefacts(epochs(s, d), ["vec_id"], 0.6).select("vec_id", "session"),
    "qc1_channels": lambda s, d: rounded(diagnostics.channel_levels(matrix(s, d)), "rms", "variance"),
    "qc2_amplitudes": lambda s, d: rounded(diagnostics.amplitudes(epochs(s, d), "session", 0.35, 0.25), "top", "pct_high", "pct_low"),
    "qc4_band_power": lambda s, d: rounded(diagnostics.band_power(_psd(s, d), ["vec_id"], 8.0, 13.0), "power"),
    "f8_ratios": lambda s, d: rounded(thirds(s, d).select("vec_id", *diagnostics.band_ratios(*[F.col(k) for k in "atb"])), "theta_alpha", "alpha_beta", "theta_beta", digits=5),
    "st3_wide": _wide,
    "st7_dwell_statistics": lambda s, d: rounded(statequality.dwell_statistics(states.runs(path(s, d), SCOPE, ORDER), 100.0), "mean", "median", "p95", digits=4),
    "st10_attractors": lambda s, d: rounded(statequality.attractors(_steps(s, d), 100.0), "self", "dwell"),
    "st11_soft": _soft,
    "st13_absorbing": lambda s, d: rounded(statequality.absorbing(states.occupancy(path(s, d), SCOPE), 0.3), "fo"),
    "st14_quality": _quality,
    "st22_persistent": lambda s, d: rounded(statequality.most_persistent(_steps(s, d)), "p"),
    "ev6_profile": lambda s, d: rounded(statequality.profile(trials(s, d).withColumn("pos", F.col("pos").cast("int")), "pos"), "p"),
    "m2_components": _pca,
    "m5_hmm_states": _hmm,
    "m12_split": lambda s, d: models.split(table(s, d, "customer"), "c_custkey"),
}

_K2 = f"""{_M}, s0 AS (SELECT dim, count(*)::DOUBLE AS n, avg(x) AS mu, var_pop(x) AS v FROM m GROUP BY dim),
s1 AS (SELECT dim, n, avg((x - mu) ** 3) / v ** 1.5 AS g1, avg((x - mu) ** 4) / v ** 2 - 3 AS g2 FROM m JOIN s0 USING (dim) GROUP BY dim, n, v),
s2 AS (SELECT *, sqrt(2 * (3 * (n*n + 27*n - 70) * (n+1) * (n+3) / ((n-2) * (n+5) * (n+7) * (n+9)) - 1)) - 1 AS w2, 6 * (n*n - 5*n + 2) / ((n+7) * (n+9)) * sqrt(6 * (n+3) * (n+5) / (n * (n-2) * (n-3))) AS b FROM s1),
s3 AS (SELECT *, g1 * sqrt((n+1) * (n+3) / (6 * (n-2))) / sqrt(2 / (w2 - 1)) AS y, 6 + 8 / b * (2 / b + sqrt(1 + 4 / b ** 2)) AS a, (g2 + 3 - 3 * (n-1) / (n+1)) / sqrt(24 * n * (n-2) * (n-3) / ((n+1) ** 2 * (n+3) * (n+5))) AS d FROM s2),
k2 AS (SELECT dim, (ln(y + sqrt(y*y + 1)) / sqrt(0.5 * ln(w2))) ** 2 + ((1 - 2 / (9*a) - cbrt((1 - 2/a) / (1 + d * sqrt(2 / (a - 4))))) / sqrt(2 / (9*a))) ** 2 AS k2 FROM s3)"""
_PO = f"""{_M}, ce AS (SELECT session AS state, dim, avg(x) AS c FROM m GROUP BY ALL), dq AS (SELECT row, session, state, sum((x - c) ** 2) AS q FROM m JOIN ce USING (dim) GROUP BY ALL),
wq AS (SELECT *, exp((min(q) OVER (PARTITION BY row) - q) / {2 * SPREAD * SPREAD}::DOUBLE) AS w FROM dq), po AS (SELECT row AS vec_id, session, list(w / s ORDER BY state) AS p FROM (SELECT *, sum(w) OVER (PARTITION BY row) AS s FROM wq) GROUP BY ALL)"""
_ST = f"{_A}, tm AS ({_MATRIX.format('')})"

SQL = {
    "dg5_normality": f"WITH {_K2} SELECT dim, round(k2, 5) AS k2, round(exp(-k2 / 2), 5) AS p FROM k2",
    "dg8_gaussianity": f"""WITH {_K2}, o AS (SELECT dim, skewness(x) AS sk, kurtosis(x) AS ku, avg((abs((x - mu) / sqrt(v)) > 3)::INT) AS f FROM m JOIN s0 USING (dim) GROUP BY dim),
        g AS (SELECT dim, exp(-k2 / 2) AS p, greatest(0, least(1, 1 - least(abs(sk) / 5, 0.35) - least(abs(ku) / 10, 0.3) - least(5 * f, 0.2) - CASE WHEN exp(-k2/2) < 1e-6 THEN 0.15 WHEN exp(-k2/2) < 1e-3 THEN 0.1 WHEN exp(-k2/2) < 0.05 THEN 0.05 ELSE 0 END))::DOUBLE AS score FROM o JOIN k2 USING (dim))
        SELECT dim, round(score, 5) AS score, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.65 THEN 'good' WHEN score >= 0.45 THEN 'acceptable' WHEN score >= 0.25 THEN 'poor' ELSE 'very_poor' END AS label FROM g""",
    "dg10_smoothness": f"WITH {_M}, q AS (SELECT *, lag(x) OVER (PARTITION BY session, dim ORDER BY row) AS prev FROM m) SELECT session, dim, round(CASE WHEN stddev_pop(x) < 1e-12 THEN 0 ELSE corr(x, prev) END, 5) AS lag1, round(avg(abs(x - prev)), 5) AS step, round(avg(abs(x - prev)) / (stddev_pop(x) + 1e-12), 5) AS ratio, round(stddev_pop(x), 5) AS sd FROM q GROUP BY ALL",
    "dg11_stationarity": f"WITH {_M}, q AS (SELECT *, row_number() OVER (PARTITION BY session, dim ORDER BY row) - 1 AS t, count(*) OVER (PARTITION BY session, dim) AS n FROM m) SELECT session, dim, round(regr_slope(x, t), 6) + 0.0 AS slope, round(abs(avg(x) FILTER (t >= n - greatest(5, n // 10)) - avg(x) FILTER (t < greatest(5, n // 10))), 6) AS shift FROM q GROUP BY ALL",
    "dg21_between_sessions": f"WITH {_M}, q AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY row, dim) AS t, count(*) OVER (PARTITION BY session) AS n FROM m), l AS (SELECT min(n) AS n FROM q), b AS (SELECT session, var_pop(x) AS v, avg(x) AS m FROM q WHERE t <= (SELECT n FROM l) GROUP BY session), a AS (SELECT avg(v) AS w, var_pop(m) AS b FROM b) SELECT round(w, 5) AS within, round(b, 5) AS between, round(b / (w + 1e-12), 5) AS ratio, round(b / (w + 1e-12) / (1 + b / (w + 1e-12)), 5) AS fingerprint, CASE WHEN b / (w + 1e-12) / (1 + b / (w + 1e-12)) < 0.15 THEN 'low' WHEN b / (w + 1e-12) / (1 + b / (w + 1e-12)) < 0.35 THEN 'moderate' WHEN b / (w + 1e-12) / (1 + b / (w + 1e-12)) < 0.6 THEN 'high' ELSE 'extreme' END || '_subject_signature' AS label FROM a".replace("AS between", 'AS "between"').replace("AS within", 'AS "within"'),
    "pre4_reject": "SELECT vec_id, label AS session FROM embeddings WHERE list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE <= 0.6",
    "qc1_channels": f"WITH {_M}, r AS (SELECT dim, sqrt(avg(x * x)) AS rms, var_pop(x) AS v FROM m GROUP BY dim) SELECT dim, round(rms, 6) AS rms, round(v, 6) AS variance, abs((rms - avg(rms) OVER ()) / stddev_pop(rms) OVER ()) > 2 AS bad FROM r",
    "qc2_amplitudes": "WITH a AS (SELECT label AS session, greatest(list_max(embedding), -list_min(embedding))::DOUBLE AS t FROM embeddings) SELECT session, round(max(t), 6) AS top, count(*) FILTER (t > 0.35) AS n_high, count(*) FILTER (t > 0.25) AS n_low, count(*) AS n_epochs, round(100 * avg((t > 0.35)::INT), 6) AS pct_high, round(100 * avg((t > 0.25)::INT), 6) AS pct_low FROM a GROUP BY session",
    "qc4_band_power": f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(range(8, 13), lambda f: (x[f + 1] ** 2 + x[f + 2] ** 2) / 2)), 6) AS power FROM e",
    "f8_ratios": f"WITH {_E}, {_THIRDS}, l AS (SELECT vec_id, ln(abs(a) + 1e-10) AS a, ln(abs(t) + 1e-10) AS t, ln(abs(b) + 1e-10) AS b FROM th) SELECT vec_id, round(t - a, 5) AS theta_alpha, round(a - b, 5) AS alpha_beta, round(t - b, 5) AS theta_beta FROM l",
    "st3_wide": f"{_A} SELECT session, " + ", ".join(f"round(max({c}) FILTER (state = '{k}'), 6) AS {m}_{k}" for m, c in (("fo", "fo"), ("dwell", "dwell_sec")) for k in EVENT_TYPES) + " FROM fo LEFT JOIN dw USING (session, state) GROUP BY session",
    "st7_dwell_statistics": f"{_A} SELECT state, round(avg(length * 100.0::DOUBLE), 4) AS mean, round(quantile_cont(length * 100.0::DOUBLE, 0.5), 4) AS median, round(quantile_cont(length * 100.0::DOUBLE, 0.95), 4) AS p95, count(*) AS n_runs, sum(length)::BIGINT AS n_windows FROM r GROUP BY state",
    "st10_attractors": f"{_ST}, q AS (SELECT i AS state, coalesce(max(p) FILTER (i = j), 0)::DOUBLE AS s FROM tm GROUP BY i) SELECT state, round(s, 6) AS self, round(100.0 / greatest(1 - s, 1e-9), 6) AS dwell, s > 0.97 OR 100.0 / greatest(1 - s, 1e-9) > 5000 AS attractor FROM q",
    "st11_soft": f"WITH {_PO}, q AS (SELECT vec_id, p, -list_sum(list_transform(p, lambda v: v * ln(v + 1e-12))) AS h, list_max(p) AS c FROM po) SELECT vec_id, round(h, 5) AS entropy, round(h / ln(len(p)), 5) AS relative, round(c, 5) AS confidence, CASE WHEN c > 0.85 THEN 'discrete' WHEN c > 0.65 THEN 'metastable' ELSE 'continuous' END AS regime FROM q",
    "st13_absorbing": f"{_A} SELECT session, state, round(fo, 6) AS fo FROM fo WHERE fo > 0.3",
    "st14_quality": f"{_ST}, f AS (SELECT state, avg(fo) AS f FROM fo GROUP BY state), w AS (SELECT state, avg(length) * 100 AS d FROM r GROUP BY state), c AS (SELECT i AS state, max(p) AS c FROM tm GROUP BY i), q AS (SELECT (min(f) >= 0.1)::INT + (max(d) <= 2000)::INT + (max(f) - min(f) <= 0.3)::INT + (avg(c) >= 0.6)::INT AS score FROM f JOIN w USING (state) JOIN c USING (state)) SELECT score, CASE score WHEN 4 THEN 'REPORTAR' WHEN 3 THEN 'ACEPTABLE' ELSE 'REVISAR' END AS verdict FROM q",
    "st22_persistent": f"{_ST} SELECT i AS state, round(p, 6) AS p FROM tm WHERE i = j ORDER BY tm.p DESC, i LIMIT 1",
    "ev6_profile": f"WITH {_P}, {_TR} SELECT pos::INT AS pos, state, round(count(*) / sum(count(*)) OVER (PARTITION BY pos)::DOUBLE, 6) AS p FROM tr GROUP BY pos, state",
    "m12_split": "SELECT DISTINCT c_custkey, ('0x' || left(md5('42:' || c_custkey), 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < 0.2 AS test FROM customer",
}
