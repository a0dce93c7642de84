"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is
built.  A document is parsed against each automaton into the longest pieces that
occur in the sample; the language that needs fewest phrases, normalised by
``log2`` of the sample's length and the document's length, wins.  Symbols are the
UTF-8 bytes of letters in lower case, and one symbol for everything else, so any
script fits and each language has the alphabet of its own sample.  Documents are
parsed whole, in segments of ``SEGMENT`` symbols side by side, a new phrase at
each segment.

The sample has at most ``DOCS`` labelled documents a language and ends with the
one that reaches ``SAMPLE_CHARS`` characters.  They are taken in order of a hash
of their ids, those of more than ``LONG_TEXT`` characters last, and of each at most a piece of ``PIECE``.

Texts that are null or hold no letter are ``und`` with score 0, and so is every
text if nothing is labelled; a null id counts as held out; repeated rows are
predicted one by one; ties go to the first language in order; columns named
``lang_pred`` or ``score`` are replaced, others pass through; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesostate.llm.common import new_columns, read
from mesostate.llm.pretokens import LETTER, _classes
from mesostate.llm.textops import buffers, ragged, runs

#: The sample: documents a language, characters at which it ends, length from which a document comes last, most characters of one.
DOCS, SAMPLE_CHARS, LONG_TEXT, PIECE = 48, 48_000, 4096, 4096
SEGMENT = 256
#: Byte that stands for everything that is no letter.
NO_LETTER = 0x20


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """Each code point in lower case where that is one code point; ``NO_LETTER`` where it is no letter."""
    out = np.full(0x110000, NO_LETTER, "<u4")
    for c in np.flatnonzero(_classes() == LETTER).tolist():
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, where each text starts in them (one more at the end), and whether it has a letter."""
    data, offsets = buffers(column)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = _lowered()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")]
    first = np.searchsorted(at, offsets)
    letters = np.concatenate([np.zeros(1, np.int64), np.cumsum(code != NO_LETTER)])[first]
    sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64))])
    return np.frombuffer(code.tobytes().decode("utf-32-le").encode(), np.uint8), sizes[first], np.diff(letters) > 0


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions ``[state, symbol]`` of the suffix automaton of a sequence; -1 where there is none, state 0 first."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in after[p]:
            after[p][s] = new
            p = link[p]
        if p >= 0:
            q = after[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(s) == q:
                    after[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.full((len(after), width), -1, np.int32)
    for state, edges in enumerate(after):
        for s, to in edges.items():
            out[state, s] = to
    return out


@dataclass
class Model:
    """For each language its name, the own symbol of each byte (0: none in the sample), automaton and bits a phrase.

    The last symbol of an automaton only fills segments up.
    """

    languages: list[str]
    own: list[np.ndarray]
    tables: list[np.ndarray]
    bits: np.ndarray

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> Model:
        languages, own, tables, bits = [], [], [], []
        for language in sorted(samples):
            symbols, _, letters = symbols_of(pa.array(["\n".join(samples[language])], pa.large_string()))
            if not letters[0]:
                continue
            alphabet = np.unique(symbols)
            lookup = np.zeros(256, np.int32)
            lookup[alphabet] = np.arange(1, len(alphabet) + 1)
            table = automaton(lookup[symbols].tolist(), len(alphabet) + 2)
            table[:, -1] = np.arange(len(table))
            languages.append(language)
            own.append(lookup)
            tables.append(table)
            bits.append(np.log2(max(2, len(symbols))))
        return cls(languages, own, tables, np.array(bits))

    def phrases(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each language and text, symbols of each text, and whether it has a letter."""
        symbols, first, letters = symbols_of(column)
        sizes = np.diff(first)
        segments = -(-sizes // SEGMENT)
        place = ragged(np.zeros(len(sizes), np.int64), sizes)
        row, col = place % SEGMENT, np.repeat(np.cumsum(segments) - segments, sizes) + place // SEGMENT
        ends = np.cumsum(segments)
        out = np.zeros((len(self.languages), len(sizes)), np.int64)
        for k, (lookup, table) in enumerate(zip(self.own, self.tables, strict=True)):
            grid = np.full((SEGMENT, int(segments.sum())), table.shape[1] - 1, np.int32)
            grid[row, col] = lookup[symbols]
            flat, width = table.ravel(), table.shape[1]
            restart = np.maximum(table[0], 0)  # of an unknown symbol: the root
            state, count = np.zeros(grid.shape[1], np.int32), np.ones(grid.shape[1], np.int64)
            for step in grid:
                to = flat[state * width + step]
                failed = to < 0
                count += failed
                state = np.where(failed, restart[step], to)
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
            out[k] = sums[ends] - sums[ends - segments]
        return out, sizes, letters

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(column), [0.0] * len(column)
        phrases, sizes, letters = self.phrases(column)
        total = phrases * self.bits[:, None] / np.maximum(sizes, 1)
        best, ordered = total.argmin(axis=0), np.sort(total, axis=0)
        score = 1.0 - ordered[0] / np.maximum(ordered[1], 1e-12) if len(self.languages) > 1 else np.ones(len(sizes))
        return (
            [self.languages[b] if h else "und" for b, h in zip(best.tolist(), letters.tolist(), strict=True)],
            np.where(letters, np.clip(score, 0.0, 1.0), 0.0).tolist(),
        )


def held_out(key: str = "doc_id"):
    """True for the fifth of the rows that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of a bounded sample of labelled documents, none of them held out.

    Of a document of over ``PIECE`` characters, a piece of so many from a place that its id determines is learned; predictions
    are of whole texts.
    """
    labelled = docs.where(F.col(lang).isNotNull() & ~held_out(key) & F.col(text).rlike(r"\p{L}")).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.length(text).alias("n"))
    order = [F.col("n") > LONG_TEXT, F.xxhash64("key"), "key", "n"]
    ranked = labelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= DOCS)
    before = F.sum(F.least("n", F.lit(PIECE))).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    chosen = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SAMPLE_CHARS).select("key", "lang", "n").distinct()
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.length(text).alias("n"))
    texts = rows.join(F.broadcast(chosen), ["key", "lang", "n"], "left_semi")  # DOCS ids a language
    place = F.pmod(F.xxhash64("key"), F.greatest(F.col("n") - PIECE + 1, F.lit(1))).cast("int") + 1
    texts = texts.withColumn("text", F.substring(F.col("text"), place, F.lit(PIECE)))
    samples: dict[str, list[str]] = {}
    for row in texts.groupBy("key", "lang", "n").agg(F.min("text").alias("text")).orderBy("lang", F.xxhash64("key"), "key", "n").collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    return Model.fit(samples)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    docs = new_columns(docs, "lang_pred", "score")
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, text):
                best, score = shared.value.predict(run.column(text))
                yield pa.RecordBatch.from_arrays([*run.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*run.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(apply, schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language": op5_language}
SQL: dict[str, str] = {}
