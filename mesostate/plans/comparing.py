"""Registered queries of comparisons and signal kernels, and their SQL for DuckDB; kernels have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesostate.operators import comparison, kernels, matrices, states
from mesostate.plans import extended
from mesostate.plans.catalogue import _A, _E, _M, SCOPE, epochs, matrix, path, rounded, table

RATE = 250.0
GROUPS = ("BUILDING", "MACHINERY")


def _posterior(s, d) -> DataFrame:
    return extended.posterior(s, d).withColumn("pos", F.col("vec_id") % 9)


def _grouped(s, d) -> DataFrame:
    groups = table(s, d, "customer").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("grp"))
    return states.occupancy(path(s, d), SCOPE).join(groups, "session")


def _centroids(s, d) -> DataFrame:
    m = matrix(s, d)
    centroids = matrices.centroids(m, "session").withColumnRenamed("session", "state")
    return rounded(comparison.centroid_distance(m, centroids, "session"), "mean", "sd", "rest", "z", digits=4)


def _sensitivity(s, d) -> DataFrame:
    half = lambda at: epochs(s, d).select(F.col("vec_id").alias("row"), F.posexplode(F.slice("samples", at, 32)).alias("dim", "x"))
    return rounded(comparison.window_sensitivity(half(1), half(33)), "r", "gap", digits=5)


def _suitability(s, d) -> DataFrame:
    """From the scores that dg8, dg10 and dg21 return."""
    q = extended.QUERIES
    steady = q["dg10_smoothness"](s, d).groupBy("dim").agg(F.avg("lag1").alias("lag1"), F.avg("ratio").alias("noise"))
    scores = q["dg8_gaussianity"](s, d).select("dim", F.col("score").alias("gauss")).join(steady, "dim").crossJoin(q["dg21_between_sessions"](s, d).select("fingerprint"))  # one row
    return rounded(comparison.suitability(scores).select("dim", "temporal", "suitability", "label", "warnings"), "temporal", "suitability", digits=4)


def _envelopes(s, d) -> DataFrame:
    bands = {"theta": (4, 8), "alpha": (8, 13), "beta": (13, 30)}
    found = [kernels.envelope("samples", RATE, *band, "floor" if name == "theta" else "log1p").alias(name) for name, band in bands.items()]
    return rounded(epochs(s, d).select("vec_id", *found), *bands)


def _long(signal: DataFrame) -> DataFrame:
    return signal.select("vec_id", F.posexplode("samples").alias("t", "x")).withColumn("x", F.round("x", 6))


QUERIES = {
    "cmp1_profiles": lambda s, d: rounded(comparison.profiles(matrix(s, d), "session"), "z", digits=5),
    "cmp2_most_alike": lambda s, d: rounded(comparison.most_alike(comparison.likeness(comparison.profiles(matrix(s, d), "session"))), "cosine", "mean_cosine", digits=5),
    "cmp3_likeness": lambda s, d: rounded(comparison.likeness(comparison.profiles(matrix(s, d), "session")), "cosine", "distance", digits=5),
    "cmp8_contrasted": lambda s, d: rounded(comparison.contrasted(comparison.profiles(matrix(s, d), "session")), "z", digits=5),
    "ev4_soft_evoked": lambda s, d: rounded(comparison.soft_evoked(_posterior(s, d), "session", "pos"), "p", "sem"),
    "stat2_standard_error": lambda s, d: rounded(comparison.standard_error(_grouped(s, d), ["grp", "state"], "fo"), "mean", "sem"),
    "stat3_difference": lambda s, d: rounded(comparison.difference(_grouped(s, d), "grp", *GROUPS), "fo_a", "fo_b", "delta"),
    "abs2_centroid_distance": _centroids,
    "abs3_onset": lambda s, d: rounded(comparison.onset(_posterior(s, d), "session", "vec_id", F.array_max("p"), 0.7), "onset", "above", digits=4),
    "dg13_window_sensitivity": _sensitivity,
    "dg17_effective_rank": lambda s, d: rounded(comparison.effective_rank(epochs(s, d), "samples"), "rank", "dominance", "mean_r", "max_r"),
    "dg25_suitability": _suitability,
    "f4_envelopes": _envelopes,
    "pre2_low_pass": lambda s, d: _long(epochs(s, d).select("vec_id", kernels.low_pass("samples", RATE, 30.0).alias("samples"))),
    "pre3_resample": lambda s, d: _long(epochs(s, d).select("vec_id", kernels.resample("samples", 500.0, RATE).alias("samples"))),
    "qc3_welch": lambda s, d: rounded(epochs(s, d).select("vec_id", F.inline(kernels.welch("samples", RATE))), "p", digits=9),
}

_PR = f"WITH {_M}, sc AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM m GROUP BY dim), pr AS (SELECT session AS state, dim, avg((x - mu) / sd) AS z FROM m JOIN sc USING (dim) GROUP BY ALL)"
_LK = f"{_PR}, lk AS (SELECT a.state AS i, b.state AS j, sum(a.z * b.z) / sqrt(sum(a.z ** 2) * sum(b.z ** 2)) AS cosine, sqrt(sum((a.z - b.z) ** 2)) AS distance FROM pr a JOIN pr b ON a.dim = b.dim AND a.state <> b.state GROUP BY ALL)"
_PO = extended._PO
_GR = f"{_A}, gr AS (SELECT c_mktsegment AS grp, state, fo FROM fo JOIN customer ON session = c_custkey)"

SQL = {
    "cmp1_profiles": f"{_PR} SELECT state, dim, round(z, 5) AS z FROM pr",
    "cmp2_most_alike": f"{_LK} SELECT i, arg_min(j, (-round(cosine, 9), j)) AS j, round(max(cosine), 5) AS cosine, round(avg(cosine), 5) AS mean_cosine FROM lk GROUP BY i",
    "cmp3_likeness": f"{_LK} SELECT i, j, round(cosine, 5) AS cosine, round(distance, 5) AS distance FROM lk",
    "cmp8_contrasted": f"{_PR} SELECT state, dim, round((z - avg(z) OVER w) / stddev_pop(z) OVER w, 5) AS z FROM pr WINDOW w AS (PARTITION BY state)",
    "ev4_soft_evoked": f"WITH {_PO}, b AS (SELECT session, pos, state, avg(v) AS v FROM (SELECT session, vec_id % 9 AS pos, unnest(range(len(p)))::INT AS state, unnest(p) AS v FROM po) GROUP BY ALL) SELECT pos, state, round(avg(v), 6) AS p, round(stddev_pop(v) / sqrt(count(*)), 6) AS sem FROM b GROUP BY pos, state",
    "stat2_standard_error": f"{_GR} SELECT grp, state, round(avg(fo), 6) AS mean, round(stddev_pop(fo) / sqrt(count(*)), 6) AS sem FROM gr GROUP BY grp, state",
    "stat3_difference": f"{_GR}, q AS (SELECT state, avg(fo) FILTER (grp = '{GROUPS[0]}') AS a, avg(fo) FILTER (grp = '{GROUPS[1]}') AS b FROM gr GROUP BY state) SELECT state, round(a, 6) AS fo_a, round(b, 6) AS fo_b, round(abs(a - b), 6) AS delta, CASE WHEN abs(a - b) < 0.02 THEN 'robusto' WHEN abs(a - b) < 0.05 THEN 'leve' ELSE 'significativo' END AS effect FROM q",
    "abs2_centroid_distance": f"WITH {_M}, c AS (SELECT session AS state, dim, avg(x) AS m FROM m GROUP BY ALL), e AS (SELECT session, row, state, sqrt(sum((x - c.m) ** 2)) AS d FROM m JOIN c USING (dim) GROUP BY ALL), b AS (SELECT session, state, avg(d) AS mean, stddev_pop(d) AS sd FROM e GROUP BY ALL) SELECT a.session, a.state, round(any_value(a.mean), 4) AS mean, round(any_value(a.sd), 4) AS sd, round(avg(o.mean), 4) AS rest, round((any_value(a.mean) - avg(o.mean)) / (stddev_pop(o.mean) + 1e-9), 4) AS z FROM b a JOIN b o ON a.state = o.state AND a.session <> o.session GROUP BY a.session, a.state",
    "abs3_onset": f"WITH {_PO}, q AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY vec_id) - 1 AS t, list_max(p) > 0.7 AS high FROM po) SELECT session, round(100 * min(t) FILTER (high) / count(*)::DOUBLE, 4) AS onset, round(100 * count(*) FILTER (high) / count(*)::DOUBLE, 4) AS above FROM q GROUP BY session",
    "dg13_window_sensitivity": f"WITH {_M}, q AS (SELECT corr(a.x, b.x) AS r, avg(abs(a.x - b.x)) AS gap FROM m a JOIN m b ON a.row = b.row AND b.dim = a.dim + 32) SELECT round(r, 5) AS r, round(gap, 5) AS gap, CASE WHEN r > 0.9 THEN 'robust' WHEN r > 0.7 THEN 'moderate' ELSE 'sensitive' END AS label FROM q",
    "dg25_suitability": f"WITH g AS ({extended.SQL['dg8_gaussianity']}), l AS (SELECT dim, avg(lag1) AS lag1, avg(ratio) AS noise FROM ({extended.SQL['dg10_smoothness']}) GROUP BY dim), f AS ({extended.SQL['dg21_between_sessions']}), t AS (SELECT dim, g.score AS gauss, greatest(0, least(1, (lag1 + 1) / 2))::DOUBLE * exp(-noise) AS temporal, greatest(0, least(1, 1 - fingerprint))::DOUBLE AS steady FROM g JOIN l USING (dim) CROSS JOIN f), q AS (SELECT *, 0.4::DOUBLE * gauss + 0.35::DOUBLE * temporal + 0.15::DOUBLE * steady + 0.05::DOUBLE AS s FROM t) SELECT dim, round(temporal, 4) AS temporal, round(s, 4) AS suitability, CASE WHEN s >= 0.8 THEN 'excellent' WHEN s >= 0.65 THEN 'good' WHEN s >= 0.45 THEN 'acceptable' WHEN s >= 0.25 THEN 'poor' ELSE 'very_poor' END AS label, concat_ws(',', CASE WHEN gauss < 0.4 THEN 'gauss' END, CASE WHEN temporal < 0.35 THEN 'noise' END, CASE WHEN steady < 0.35 THEN 'identity' END) AS warnings FROM q",
    # a windowed sinc of 111 taps over samples that are turned about their ends
    "pre2_low_pass": f"""WITH {_M}, tp AS (SELECT u, CASE WHEN u = 55 THEN 1 ELSE sin(pi() * 0.27 * (u - 55)) / (pi() * 0.27 * (u - 55)) END * (0.54 - 0.46 * cos(2 * pi() * u / 110)) AS w FROM (SELECT unnest(range(111)) AS u)),
nt AS (SELECT u, w / sum(w) OVER () AS w FROM tp), ed AS (SELECT row, max(x) FILTER (dim = 0) AS a, max(x) FILTER (dim = 63) AS b FROM m GROUP BY row),
ex AS (SELECT row, dim AS t, x FROM m UNION ALL SELECT row, -dim, 2 * a - x FROM m JOIN ed USING (row) WHERE dim BETWEEN 1 AND 55 UNION ALL SELECT row, 126 - dim, 2 * b - x FROM m JOIN ed USING (row) WHERE dim BETWEEN 8 AND 62)
SELECT row AS vec_id, (t + 55 - u)::INT AS t, round(sum(x * w), 6) + 0.0 AS x FROM ex CROSS JOIN nt WHERE t + 55 - u BETWEEN 0 AND 63 GROUP BY row, t + 55 - u""",
    # the first 16 harmonics, the last of them doubled, at 32 instants
    "pre3_resample": f"""WITH {_M}, kj AS (SELECT j, t, (1 + 2 * sum(CASE WHEN k < 16 THEN cos(2 * pi() * k * (j / 32.0::DOUBLE - t / 64.0::DOUBLE)) ELSE cos(pi() * t / 2) * cos(pi() * j) END)) / 64 AS w FROM (SELECT unnest(range(32)) AS j) CROSS JOIN (SELECT unnest(range(64)) AS t) CROSS JOIN (SELECT unnest(range(1, 17)) AS k) GROUP BY j, t)
SELECT row AS vec_id, j::INT AS t, round(sum(x * w), 6) + 0.0 AS x FROM m JOIN kj ON dim = kj.t GROUP BY row, j""",
    "qc3_welch": f"""WITH {_M}, cd AS (SELECT row, dim AS t, (x - avg(x) OVER (PARTITION BY row)) * (0.5 - 0.5 * cos(2 * pi() * dim / 64)) AS w FROM m),
cs AS (SELECT row, k, sum(w * cos(2 * pi() * k * t / 64)) AS c, sum(w * sin(2 * pi() * k * t / 64)) AS s FROM cd CROSS JOIN (SELECT unnest(range(1, 12)) AS k) GROUP BY row, k) SELECT row AS vec_id, k * {RATE} / 64::DOUBLE AS f, round(2 * (c * c + s * s) / ({RATE} * 24), 9) AS p FROM cs""",
}
