"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Row numbers follow (id, text checksum, size), so they depend on the rows alone
and not on how they were read.  The permutation sends row ``n`` of ``N`` to
place ``p``; shard ``p mod shards`` and slot ``p div shards`` follow by
arithmetic, for one row without looking at any other.  Counts of shards differ
by one at most (law ``rows``) and slots have no gaps.

Null ids come first, null texts have no bytes, texts of any length only give
their size and checksum, repeated rows are rows of their own (which of them gets
which place does not matter), further columns pass through whatever their names,
columns ``shard`` and ``slot`` are replaced, and an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.llm.common import checkpoint, free_name, new_columns, read
from mesostate.llm.textops import mix

ROUNDS = 6


def permute(rows: np.ndarray, total: int, seed: int = 7) -> np.ndarray:
    """Places of row numbers under a keyed permutation of ``range(total)``.

    A balanced Feistel network permutes the next even power of two; numbers
    that fall outside ``range(total)`` walk on along their cycle.
    """
    half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    out = rows.astype(np.uint64)
    out_of_range = np.ones(len(out), bool)
    while out_of_range.any():
        x = out[out_of_range]
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (mix(right ^ key) & mask)
        out[out_of_range] = (left << half) | right
        out_of_range = out >= np.uint64(total)
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], column: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with global numbers from 0 in the given order, and their count, without moving rows to one task.

    The rows are range-partitioned and checkpointed; only one count a partition
    goes to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpoint(placed.withColumn(column, F.monotonically_increasing_id()))
    name = free_name(placed, "_part")
    part, within = F.shiftright(F.col(column), 33), F.col(column).bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):
        before[row["part"]], total = total, total + row["count"]
    bases = spark.createDataFrame([(int(k), int(v)) for k, v in before.items()] or [(0, 0)], f"`{name}` long, `{name}_base` long")
    numbered = placed.withColumn(name, part).join(F.broadcast(bases), name, "left")  # one row a partition
    return numbered.withColumn(column, F.col(f"{name}_base") + within).select(*[F.col(f"`{c}`") for c in placed.columns]), total


def shard(df: DataFrame, order: list[str], shards: int, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a reproducible shuffle of its rows into shards of equal counts."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    df = new_columns(df, *{"shard", "slot"}.difference(order))
    name = free_name(df, "_row")
    numbered, total = number_rows(df, order, name)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), total, seed) if len(row) else [], dtype="int64")

    placed = numbered.withColumn(name, place(name))
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col(name) % shards).cast("int").alias("shard"),
        F.expr(f"`{name}` div {shards}").alias("slot"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    small = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard(small, ["doc_id", "text_crc32", "size"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op9_sharding": op9_sharding}
SQL: dict[str, str] = {}
