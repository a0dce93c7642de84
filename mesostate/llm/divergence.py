"""How far the words of each source are from those of the other sources of its language, in whole numbers.

Documents are cut into terms and counted a run of texts at a time; Spark adds the
counts up, keeps a language's terms of three documents at least, and gathers
them into a term-major index: a row a term, with the groups that hold it.  A
task that holds a block of that index takes one group after another and scatters
its terms through the index into a dense accumulator over the group's peers
(Gustavson's order of a sparse product), so that no pair of postings becomes a row
and a task emits a number a pair of groups at most.  The accumulator holds what a shared term
adds beyond zero counts; a second sum, over how often each count occurs in a
group, corrects the baselines of terms that one side or neither has.

Null texts, languages and sources count as empty strings; empty texts and texts
without a term still make their group occur; a text of any length is counted in
one piece; repeated rows count each; ties rank by term or source in UTF-8 order.
An empty table gives no rows.  Further columns, whatever their names, are not read.

A row of the index has a number a source of its language at most; the result has
one a pair of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesostate.llm.common import drop, looked_up, read, stored
from mesostate.llm.pretokens import distinct_ranges
from mesostate.llm.textops import buffers, runs

#: A term is kept in a language that has it in so many documents.
LEAST_DOCUMENTS = 3
#: Terms that are reported for a group.
REPORTED = 200
#: Probabilities are shares of this number.
UNIT = 1_000_000_000
#: Bytes of text that are counted together.
COUNTED_BYTES = 8 << 20

# bytes outside terms: all of ASCII but letters; capitals become small
_IN_TERM = np.ones(256, bool)
_IN_TERM[:0x41] = _IN_TERM[0x5B:0x61] = _IN_TERM[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def term_counts(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and of each term and group of texts that meet: term, group, occurrences, texts."""
    low = _LOWER[data]
    inside = _IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text ends its terms
    before = np.append(False, inside[:-1]) & ~edge[:-1]
    after = np.append(inside[1:], False) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return [], *(np.zeros(0, np.int64) for _ in range(4))
    lengths = ends - starts
    tight = low[inside]  # terms side by side
    tight_ends = np.cumsum(lengths)
    codes, first = distinct_ranges(tight, tight_ends - lengths, tight_ends)
    whole = tight.tobytes()
    terms = [whole[b - n : b].decode() for b, n in zip(tight_ends[first].tolist(), lengths[first].tolist(), strict=True)]
    text = np.searchsorted(offsets, starts, "right") - 1
    both, n = np.unique(text * len(terms) + codes, return_counts=True)
    text, codes = both // len(terms), both % len(terms)
    cell, at = np.unique(groups[text] * len(terms) + codes, return_inverse=True)
    return terms, cell % len(terms), cell // len(terms), np.bincount(at, n, len(cell)).astype(np.int64), np.bincount(at, minlength=len(cell))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in runs(batch, most=COUNTED_BYTES):
            lang, source = run.column("lang").to_pylist(), run.column("source").to_pylist()
            groups, names = pd.factorize(pd.MultiIndex.from_arrays([lang, source]))
            terms, term, group, n, texts = term_counts(*buffers(run.column("text")), groups.astype(np.int64))
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in names]).take(pa.array(group)), pa.array([k[1] for k in names]).take(pa.array(group)), pa.array(terms).take(pa.array(term)), pa.array(n), pa.array(texts, pa.int64())],
                    ["lang", "source", "term", "n", "texts"],
                )


def _div(a: Column, b: Column) -> Column:
    """Whole part of a quotient of whole numbers."""
    return F.call_function("div", a, b)


def probability(n: Column, total: Column) -> Column:
    """``1 + floor(UNIT * (n + 1) / total)`` of longs, exactly."""
    return (F.lit(1) + _div(F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)"))).cast("long")


def spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / q)`` of whole numbers."""
    return (p - q) ** 2 // q


def _scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``lang, g, h, value``: what the terms of a block of the index add for each pair of groups beyond zero counts."""
    for batch in batches:
        for lang, block in batch.groupby("lang", sort=False):
            sizes = block["postings"].map(len).to_numpy()
            flat = [p for postings in block["postings"] for p in postings]
            g, p, zero = (np.array([x[k] for x in flat], np.int64) for k in ("g", "p", "zero"))
            starts = np.cumsum(sizes) - sizes
            term = np.repeat(np.arange(len(sizes)), sizes)
            peers, g = np.unique(g, return_inverse=True)
            rows = np.argsort(g, kind="stable")
            edges = np.searchsorted(g[rows], np.arange(len(peers) + 1))
            out = []
            for k in range(len(peers)):
                mine = rows[edges[k] : edges[k + 1]]
                n = sizes[term[mine]]
                own = np.repeat(mine, n)
                other = np.repeat(starts[term[mine]] - (np.cumsum(n) - n), n) + np.arange(len(own))
                adds = spread(p[own], p[other]) - spread(p[own], zero[other]) - spread(zero[own], p[other]) + spread(zero[own], zero[other])
                held = np.zeros(len(peers), np.int64)
                np.add.at(held, g[other], adds)
                held[k] = 0
                to = np.flatnonzero(held)
                out.append(pd.DataFrame({"lang": lang, "g": peers[k], "h": peers[to], "value": held[to]}))
            yield pd.concat(out)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to each other source of the language, and terms above the language's share."""
    spark = docs.sparkSession
    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = filled.mapInArrow(_count, "lang string, source string, term string, n long, texts long")
    counts, counts_path = stored(counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("texts").alias("texts"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("held")).where(F.col("texts") >= LEAST_DOCUMENTS).drop("texts")
    kept, kept_path = stored(kept, "kept-terms")
    drop(spark, counts_path)

    # groups, numbered in a language: a row each
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = kept.select("lang", F.explode("held").alias("p")).groupBy("lang", F.col("p.source").alias("source")).agg(F.sum("p.n").alias("total"))
    groups = filled.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    zero = F.when(F.col("v") > 0, probability(F.lit(0).cast("long"), F.col("total") + F.col("v")))
    numbered = groups.withColumn("zero", zero).withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    groups, groups_path = stored(numbered.withColumn("group", F.struct("lang", "source")), "groups")

    flat = kept.select("lang", "term", "lang_n", F.explode("held").alias("p")).select("lang", "term", "lang_n", "p.source", "p.n", F.struct("lang", "p.source").alias("group"))
    known = looked_up(flat, groups.select("group", "g", "zero", "total", "v", "lang_total"), "group", ["term"])
    shares = known.select("lang", "term", "source", "g", "zero", probability(F.col("n"), F.col("total") + F.col("v")).alias("p"), probability(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("q"))
    shares, shares_path = stored(shares, "shares")

    # pairs: shared terms through the index, then baselines
    index = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "zero")).alias("postings")).select("lang", "postings")
    shared = index.mapInPandas(_scatter, "lang string, g long, h long, value long")
    peers = groups.select("lang", F.col("g").alias("h"), F.col("zero").alias("hz"))
    f = lambda p, q: _div((p - q) * (p - q), q)
    z, hz, p, n = F.col("zero"), F.col("hz"), F.col("p"), F.col("n")
    histogram = shares.groupBy("lang", "g", "zero", "p").agg(F.count(F.lit(1)).alias("n"))
    against = histogram.join(peers, "lang").where("g != h")  # a peer's zero share against each distinct share of a group: sums, not pairs of postings
    both = F.explode(F.array(F.struct(F.col("g"), F.col("h"), (n * (f(p, hz) - f(z, hz))).alias("value")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), (n * (f(hz, p) - f(hz, z))).alias("value"))))
    one_sided = against.select("lang", both.alias("x")).select("lang", "x.g", "x.h", "x.value")
    pairs = groups.select("lang", "source", "g", "zero", "v").join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("zero").alias("hz")), "lang").where("g != h")
    neither = pairs.select("lang", "g", "h", F.when(F.col("v") > 0, F.col("v") * f(z, hz)).otherwise(F.lit(0).cast("long")).alias("value"))
    sums = shared.unionByName(one_sided).unionByName(neither).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    named = pairs.select("lang", "source", "item", "g", "h").join(sums, ["lang", "g", "h"])
    pair_rows = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))
    term_rows = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= REPORTED)
    found, _ = stored(pair_rows.unionByName(term_rows), "divergence")
    drop(spark, kept_path, groups_path, shares_path)
    return found


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark each source."""
    return audit(read(spark, sf_dir, "documents"))


def _share(n: str, total: str, v: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + {v}))"


SQL = {
    "op12_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
full_p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {_share("coalesce(c.n, 0)", "g.total", "l.v")} AS p, {_share("kept.lang_n", "l.lang_total", "l.v")} AS q
    FROM g JOIN l ON g.lang = l.lang JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM full_p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts QUALIFY part = 'pair' OR rank <= 200"""
}

QUERIES = {"op12_divergence": op12_divergence}
