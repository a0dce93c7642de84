"""What the corpus operators share: reading tables, let-expressions, names that cannot clash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.storage import checkpoint, checkpoint_root, drop, scratch, stored

__all__ = ["checkpoint", "checkpoint_root", "drop", "free_name", "let", "looked_up", "new_columns", "read", "scratch", "stored", "words_of"]

#: Separator of words, for Java's and RE2's regular expressions.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once a row however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def new_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add: what it adds takes their place."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows that the table of a broadcast lookup may have (a few numbers each, so about 16 MB).
MOST_BROADCAST = 500_000
#: Parts that a hot key is split into where that table is larger.
SALTS = 32


def looked_up(df: DataFrame, table: DataFrame, key: str, spread: list[str], most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` left-joined with ``table``, which is checkpointed and has one row a key.

    A table of at most ``most`` rows is broadcast; a larger one is repeated for each of ``SALTS`` parts that ``spread``
    deals a key's rows of ``df`` to, so no key lands in one task.
    """
    if table.count() <= most:
        return df.join(F.broadcast(table), key, "left")
    salt = free_name(df, "_salt")
    dealt = df.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    parts = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(parts, [key, salt], "left").drop(salt)
