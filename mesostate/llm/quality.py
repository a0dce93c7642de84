"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule rejects documents.  On a bounded sample the cascade measures what
each rule costs and which documents it rejects.  The first rule is that of most
rejections per second; the next that of most rejections per second among what
the ones before it left, and so on.  For each document the rules then run in
that order until one rejects it.  The order changes the work, never the verdict.

A null text has no words.  Documents with fewer than ten words fail, so empty
and null texts do; very long texts are judged whole; repeated rows are judged
one by one; an empty table gives an empty result and needs no sample; further
columns are passed through whatever their names, but ``cascade`` replaces a
column of the name that it adds.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.llm.common import free_name, let, read, words_of

#: Rows of the sample that the order of the rules is fitted on.
#: Longer texts are not sampled.
SAMPLE_CHARS = 16_384
SAMPLE_ROWS = 256
#: Copies of the sample that a rule is timed on, and times; the least time counts.
COPIES, REPEATS = 4, 2
WINDOW = 5


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of ``size`` words found at least twice in the text, the first included."""

    def positions(windows: Column) -> Column:
        tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            tagged,
            lambda t: F.sort_array(
                F.transform(
                    F.filter(t, lambda e, k: F.coalesce((e["h"] == F.get(t, k - 1)["h"]) | (e["h"] == F.get(t, k + 1)["h"]), e["h"] == F.get(t, k + 1)["h"], e["h"] == F.get(t, k - 1)["h"], F.lit(False))),
                    lambda e: e["i"],
                )
            ),
        )

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - i, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(positions(h), covered)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(w) > size, some).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def _letters(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w))


MEASURED: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, w: F.size(w).cast("long"),
    "word_chars": lambda text, w: _letters(w),
    "n_symbols": lambda text, w: count_of(text, "[#*$%&|<>]"),
    "n_bangs": lambda text, w: count_of(text, "!"),
    "n_capitals": lambda text, w: count_of(text, "[A-Z]"),
    "n_repeat_words": lambda text, w: repeated_words(w),
    "lines": lambda text, w: let(lines_of(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
}


@dataclass(frozen=True)
class Measures:
    """What rules look at, by name: a value that is known already, or the expression that measures it."""

    text: Column
    words: Column
    known: dict[str, Column] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Column:
        return self.known[name] if name in self.known else MEASURED[name](self.text, self.words)


@dataclass(frozen=True)
class Rule:
    """``rejects(measures)`` is the expression that is true for a document to reject."""

    name: str
    rejects: Callable[[Measures], Column]


#: Production rules.  The first two are the base rules.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("exclamations", lambda m: 10 * m["n_bangs"] > 5 * m["n_words"]),
    Rule("capitals", lambda m: 10 * m["n_capitals"] > 4 * m["word_chars"]),
    Rule("repeated_lines", lambda m: let(m["lines"], lambda x: 2 * x["dup"] > x["n"])),
    Rule("word_length", lambda m: let(m["word_chars"], lambda n: (n < 2 * m["n_words"]) | (n > 15 * m["n_words"]))),
)


@dataclass(frozen=True)
class Profile:
    """Seconds of each rule on the copies of the sample, and which rows of the sample each rejects."""

    seconds: dict[str, float]
    rejected: dict[str, frozenset[int]]


def measure(df: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Profile:
    """Cost and rejections of each rule on at most ``sample_rows`` rows of at most ``SAMPLE_CHARS`` characters; without such rows all are 0."""
    short = df.select(F.col(text).alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    rows = short.sample(0.05, seed).take(sample_rows) or short.take(sample_rows)
    if not rows:
        return Profile({r.name: 0.0 for r in rules}, {r.name: frozenset() for r in rules})
    sample = df.sparkSession.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, text string").coalesce(1)
    copies = sample.select("k", "text", words_of(F.col("text")).alias("w"), F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("c")).persist()
    try:
        m = Measures(F.coalesce("text", F.lit("")), F.col("w"))
        hits = copies.where("c = 1").select("k", *[r.rejects(m).alias(r.name) for r in rules]).collect()
        rejected = {r.name: frozenset(h["k"] for h in hits if h[r.name]) for r in rules}

        def timed(rule: Rule) -> float:
            best = float("inf")
            for _ in range(REPEATS):
                began = time.perf_counter()
                copies.agg(F.sum(rule.rejects(m).cast("int"))).collect()
                best = min(best, time.perf_counter() - began)
            return best

        timed(rules[0])  # warms up
        base = timed(Rule("", lambda m: F.size(m.words) < 0))
        return Profile({r.name: max(1e-3, timed(r) - base) for r in rules}, rejected)
    finally:
        copies.unpersist()


def in_order(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules, each next one that of most rejections per second among the sample's rows that the ones before it left."""
    found, left, out, gone = measure(df, rules, text, sample_rows), list(rules), [], frozenset()
    while left:
        best = min(left, key=lambda r: (-len(found.rejected[r.name] - gone) / max(1e-3, found.seconds[r.name]), found.seconds[r.name], r.name))  # noqa: B023
        left.remove(best)
        out.append(best)
        gone |= found.rejected[best.name]
    return tuple(out)


def first_failure(measures: Measures, rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule, in the given order, that rejects the document; null if none does."""
    out = F.when(rules[0].rejects(measures), F.lit(rules[0].name))
    for rule in rules[1:]:
        out = out.when(rule.rejects(measures), F.lit(rule.name))
    return out


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "failed_rule") -> DataFrame:
    """``df`` with the rule that rejected each row; the rules run in the order fitted on a sample."""
    ordered = in_order(df, rules, text)
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(into, let(words_of(body), lambda w: first_failure(Measures(body, w), ordered)))


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``df`` that no rule rejects."""
    name = free_name(df, "_failed")
    return cascade(df, rules, text, name).where(F.col(name).isNull()).drop(name)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the cascade."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = in_order(docs, RULES)
    text = F.coalesce("text", F.lit(""))

    def judged(w: Column, d: Column) -> Column:
        known = {c: d[c] for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "lines")}
        return F.struct(d.alias("m"), first_failure(Measures(text, w, known), ordered).isNull().alias("passed"))

    def digest(w: Column) -> Column:
        m = Measures(text, w)
        return let(F.struct(*[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "lines")]), lambda d: judged(w, d))

    m = F.col("d.m")
    found = docs.select("doc_id", let(words_of(text), digest).alias("d"))
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return found.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        m["lines"]["dup"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & F.col("d.passed")).alias("kept"),
    )


#: DuckDB's view of one document's measures, over a relation ``docs(doc_id, text)``.
MEASURES = r"""
w0 AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
              list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
win AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w0 WHERE len(w) > 4)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
steps AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS s FROM twice),
reps AS (SELECT rid, sum(s)::BIGINT AS r FROM steps GROUP BY rid),
m AS (SELECT doc_id, w0.rid, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
             length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
      FROM w0 LEFT JOIN reps ON w0.rid = reps.rid),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_bangs > 5 * n_words
                  OR 10 * n_capitals > 4 * word_chars OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept FROM m)
"""

QUERIES = {"op8_quality": op8_quality}
SQL = {
    "op8_quality": f"""WITH docs AS (SELECT doc_id, text FROM documents), {MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
}
