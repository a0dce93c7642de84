"""Sessions of streams: runs of rows of one key with no gap of event time longer than a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_sessions(path: DataFrame, key: str, ts: str, gap: str, late: str, states: list[str], state: str = "state") -> DataFrame:
    """``key, start, end, n, n_<state>``: sessions of each key, the rows in them, and how many are in each named state.

    A row merges the sessions that it lies between.  In ``append`` mode a session is given out once the watermark has
    passed its end, ``gap`` after its last row, and its state is dropped; rows older than the watermark are left out.  On a
    table all sessions are given.  A session keeps a number a state, not its rows.
    """
    counted = path.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    found = counted.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(state) == s).alias(f"n_{s}") for s in states])
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *[f"n_{s}" for s in states])
