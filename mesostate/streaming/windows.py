"""Counts of states in windows of event time, and ways to run a stream over what its source has now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_states(path: DataFrame, ts: str, width: str, late: str, state: str = "state") -> DataFrame:
    """``start, state, n``: windows of event time and how often each state was in them.

    Works alike on streams and tables.  In ``append`` mode a window is given out once the watermark, the greatest time
    seen less ``late``, has passed its end; rows that come after that are left out, and only open windows are kept as state.  In
    ``complete`` mode all windows are kept and no row is too late.
    """
    counts = path.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), state).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), state, "n")


def replayed(counts: DataFrame, table: str, checkpoints: str) -> None:
    """Runs a stream over all that its source has now; ``table`` then holds the whole result so far as Parquet, open windows too."""

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoints).trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()


def appended(df: DataFrame, table: str, checkpoints: str) -> list[dict]:
    """Runs a stream over all that its source has now and appends what is final to ``table``, each row once over restarts.

    Returns how many rows of state each of its batches kept and how many rows were too late.
    """
    query = df.writeStream.outputMode("append").option("checkpointLocation", checkpoints).option("path", table).format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    of = lambda p: {"state_rows": sum(s["numRowsTotal"] for s in p["stateOperators"]), "late_rows": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])}
    return [of(p) for p in query.recentProgress if p["stateOperators"]]
