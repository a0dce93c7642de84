"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``RADIUS`` differing bits or fewer.  On a
bounded sample, correlated bits are grouped into disjoint partitions, and
dynamic programming gives each partition a threshold, with a sum of
``RADIUS + 1 - partitions``, such that the estimated probes and candidates are
fewest.  Two linked fingerprints then differ in some partition by its threshold
or less; every fingerprint probes that partition's buckets within the threshold
and verifies what it finds.  The sample steers the work, not the result.

Equal fingerprints are one before the search.  A first round links each probe
to one leader of each bucket, so a crowd of near copies becomes one component
with as many links as members; a second round compares, in buckets that hold
several components, only members of different ones.

A text of fewer than four words is one shingle; without a word (or null) its
fingerprint is zero.  Null ids are grouped like others and never name a
component that has an id.  Repeated rows share a fingerprint.  Further columns
are passed through by ``deduplicate`` whatever their names; ``with_fingerprint``
replaces a column of the name that it adds; texts of any length are hashed whole;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.llm.common import checkpoint, free_name, looked_up, new_columns, read
from mesostate.llm.components import components
from mesostate.llm.textops import runs

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of the sample that the partitions are fitted on.
SAMPLE = 2048
#: Cost of comparing a candidate pair, in costs of making and shuffling a probe.
PAIR_COST = 0.01
#: Thresholds that need more probes of a partition than this are not considered.
MOST_PROBES = 1024


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned SimHash of one text."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(size)), strict=False) if len(words) >= size else [words]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", into: str = "_fp") -> DataFrame:
    """``df`` with the fingerprint as a signed long."""
    df = new_columns(df, into)
    schema = df.withColumn(into, F.lit(0).cast("long")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, text):
                column = run.column(text)
                kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
                found = np.array([fingerprint(t) for t in column.cast(kind).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*run.columns, pa.array(found)], [*run.schema.names, into])

    return df.mapInArrow(add, schema)


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in ``parts`` groups of about equal size, each grown by the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    with np.errstate(all="ignore"):
        related = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 1 else np.eye(64)
    np.fill_diagonal(related, 0)
    free, out = list(range(64)), []
    for k in range(parts):
        group = [max(free, key=lambda b: (related[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < 64 * (k + 1) // parts - 64 * k // parts:
            best = max(free, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def allocate(sample: np.ndarray, total: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions (their bits) and thresholds of the least estimated cost for ``total`` fingerprints."""
    rows = sample[:512]
    apart = rows[:, None] ^ rows[None, :]
    apart = apart[np.triu_indices(len(rows), 1)]
    best: tuple[float, list] = (np.inf, [])
    for parts in range(2, radius + 2):
        groups = grouped_bits(sample, parts)
        cost: list[dict[int, float]] = []
        for bits in groups:
            mask = np.uint64(sum(1 << b for b in bits))
            distance = np.bitwise_count(apart & mask)
            own = {-1: 0.0}
            for t in range(radius + 1):
                if ball(len(bits), t) > MOST_PROBES:
                    break
                share = max((distance <= t).mean() if len(apart) else 0.0, ball(len(bits), t) / 2.0 ** len(bits))
                own[t] = total * (1.0 + ball(len(bits), t)) + PAIR_COST * share * total**2
            cost.append(own)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the sum of (threshold + 1)
        for own in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (so_far, chosen) in table.items():
                for t, c in own.items():
                    n = used + t + 1
                    if n <= radius + 1 and (n not in step or so_far + c < step[n][0]):
                        step[n] = (so_far + c, [*chosen, t])
            table = step
        found = table[radius + 1]
        if found[0] < best[0]:
            best = (found[0], [(g, t) for g, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(maxsize=64)
def flips(bits: tuple[int, ...], threshold: int) -> tuple[int, ...]:
    """All masks that flip at most ``threshold`` of the bits, as signed longs."""
    return tuple(_signed(sum(1 << b for b in c)) for k in range(threshold + 1) for c in combinations(bits, k))


def _buckets(part: int, bits: list[int], masks: tuple[int, ...]) -> Column:
    own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))).cast("long"))
    return F.transform(F.lit(list(masks)).cast("array<long>"), lambda m: F.struct(F.lit(part).cast("byte").alias("part"), own.bitwiseXOR(m).alias("key")))


def _placed(plan: list[tuple[list[int], int]], probe: bool, fps: DataFrame, *more: str) -> DataFrame:
    """A row for each bucket that a fingerprint stands in, or for each that it probes."""
    keys = F.concat(*[_buckets(part, bits, flips(tuple(bits), threshold) if probe else (0,)) for part, (bits, threshold) in enumerate(plan)])
    return fps.select("fp", *more, F.explode(keys).alias("k")).select("fp", *more, "k.part", "k.key")


def _near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def clusters(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root`` of each distinct fingerprint: fingerprints joined by links of ``radius`` bits share a root.

    ``fps`` has one row a fingerprint and is read several times, so it should be checkpointed.
    """
    total = fps.count()
    sample = np.array([r[0] for r in fps.select("fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    alone = fps.select("fp", F.col("fp").alias("root"))
    if total < 2:
        return alone
    plan = allocate(sample, total, radius)
    stands = _placed(plan, False, fps)
    buckets = stands.groupBy("part", "key").agg(F.min("fp").alias("leader"), F.count(F.lit(1)).alias("members"))
    probes = _placed(plan, True, fps)
    hits = checkpoint(probes.join(buckets, ["part", "key"]).where((F.col("members") > 1) | (F.col("leader") != F.col("fp"))))
    first = components(hits.where(_near("fp", "leader", radius)).select(F.col("fp").alias("a"), F.col("leader").alias("b")))
    known = checkpoint(fps.select("fp").join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))

    leading = known.select(F.col("fp").alias("leader"), F.col("root").alias("main"))
    ask = hits.join(known, "fp").join(leading, "leader").select("part", "key", "fp", "root", "main")
    there = _placed(plan, False, known, "root").join(buckets.where("members > 1"), ["part", "key"]).join(leading, "leader").select("part", "key", F.col("fp").alias("fp2"), F.col("root").alias("root2"), "main")
    lone = _placed(plan, False, known, "root").join(buckets.where("members = 1"), ["part", "key"]).select("part", "key", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    link = (F.col("root") != F.col("root2")) & _near("fp", "fp2", radius)
    cross = [
        ask.where("root != main").join(there.drop("main").unionByName(lone), ["part", "key"]).where(link),
        ask.where("root = main").drop("main").join(there.where("root2 != main").drop("main"), ["part", "key"]).where(link),
    ]
    cross = checkpoint(cross[0].select("root", "root2").unionByName(cross[1].select("root", "root2")).distinct())
    if cross.isEmpty():
        return known
    merged = components(cross, "root", "root2").select(F.col("node").alias("root"), F.col("root").alias("final"))
    return known.join(merged, "root", "left").select("fp", F.coalesce("final", "root").alias("root"))


def named(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs(key, fp)``, checkpointed, with ``component_id``: the least key that links reach.

    Only fingerprints that several rows or components share are looked up; any other row names itself.
    """
    fps = checkpoint(docs.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("rows")))
    roots = clusters(fps).join(fps, "fp")
    least = checkpoint(roots.groupBy("root").agg(F.min("first").alias("least"), F.sum("rows").alias("n")).where("n > 1").drop("n"))
    shared = checkpoint(looked_up(roots, least, "root", ["fp"]).where("least is not null").select("fp", F.col("least").alias("component_id")))
    found = looked_up(docs, shared, "fp", [key])
    return found.withColumn("component_id", F.coalesce("component_id", key))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = checkpoint(with_fingerprint(read(spark, sf_dir, "documents").select("doc_id", "text"), into="fp").select("doc_id", "fp"))
    return named(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of near-duplicates: that of the least id, null ids last.

    Fingerprints are made once; rows then meet the keys that stay.  Rows of one id are told apart by a hash of their
    text; of rows that repeat both, one stays.
    """
    name = free_name(df, "_key")
    row_key = F.struct(F.col(key).isNull().alias("unknown"), F.col(key).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"))  # never null itself
    keys = with_fingerprint(df.select(row_key.alias("key"), F.col(text).alias("text")), into="fp").select("key", "fp")
    fps = checkpoint(keys.groupBy("fp").agg(F.min("key").alias("first")))
    kept = clusters(fps).join(fps, "fp").groupBy("root").agg(F.min("first").alias(name)).select(name)
    # repeated rows share a key, so they meet without a further shuffle
    return df.withColumn(name, row_key).join(kept, name, "left_semi").dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in df.columns])


QUERIES = {"op3_simhash": op3_simhash}
SQL: dict[str, str] = {}
