"""Byte-level BPE by recursive queries over token positions, and decoding by ordered aggregation.

Each Spark task cuts its texts into pre-tokens and hands each distinct one that
its worker has not met yet to an in-memory DuckDB.  There a row is a token
position; a recursive query joins neighbours to the merge table, contracts each
word's leftmost pair of least rank, and goes on with the words that changed
until none does.  Decoding joins ids to the vocabulary and concatenates in
order.  Nothing is shuffled.

A pre-token that is itself a vocabulary entry is that entry.  In the recursion a
later row takes the place of an earlier one of the same position, so it holds no
more rows than bytes; as each step goes over all positions of a word, pre-tokens
of more than ``LONG_WORD`` bytes are contracted by a heap over the same merge
table instead.  Texts of any length are decoded in pieces of ``PIECE`` ids, and
DuckDB may not spill to the worker's disk.

A null text is empty and has no ids; repeated rows and further columns pass
through; where a column has the name of an added one, the added one takes its
place; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.llm.common import new_columns, read
from mesostate.llm.pretokens import DIGIT, LETTER, OTHER, WordEncoder, per_text, split
from mesostate.llm.textops import buffers, runs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG_WORD = 96
#: Positions of words that one recursive query gets; more words take more queries.
POSITIONS = 200_000
#: Ids that one query decodes.
PIECE = 200_000
#: Bytes of text that a worker encodes at once.
RUN_BYTES = 1 << 20

#: A row is a token at a byte position ``k`` (word, then place) that spans so many bytes; a contracted right neighbour has id -1.
_ENCODE = """
WITH RECURSIVE step(k, id, span) USING KEY (k) AS (
    SELECT k, id, 1::BIGINT FROM symbols
    UNION ALL (
        WITH pair AS (SELECT a.k AS k, b.k AS right_k, b.k + b.span AS stop, (rank << 20) | (a.k & 1048575) AS p
                      FROM step a JOIN step b ON b.k = a.k + a.span JOIN merges ON ab = ((a.id << 32) | b.id) WHERE a.id >= 0 AND b.id >= 0),
             best AS (SELECT k >> 20 AS word, min(p) AS p, arg_min(k, p) AS left_k, arg_min(right_k, p) AS right_k, arg_min(stop, p) AS stop FROM pair GROUP BY 1)
        SELECT step.k, CASE step.k WHEN left_k THEN p >> 20 WHEN right_k THEN -1 ELSE id END, CASE step.k WHEN left_k THEN stop - left_k ELSE span END
        FROM step JOIN best ON (step.k >> 20) = word WHERE id >= 0
    )
)
SELECT k >> 20 AS word, list(id ORDER BY k) AS ids FROM step WHERE id >= 0 GROUP BY 1
"""

_DECODE = "SELECT word, string_agg(hex, '' ORDER BY pos) AS hex FROM tokens JOIN vocabulary USING (id) GROUP BY word ORDER BY word"


@lru_cache(maxsize=1)
def _prober() -> tiktoken.Encoding:
    """An encoding in which ``a`` and ``0`` merge with what follows them in one match of the pattern."""
    ranks = {bytes([b]): b for b in range(256)}
    for one in (b"a", b"0"):
        for first in range(0xC2, 0xF5):
            ranks[one + bytes([first])] = len(ranks)
    return tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def probe(char: str) -> int:
    for one, kind in (("a", LETTER), ("0", DIGIT)):
        if len(_prober().encode_ordinary(one + char)) == len(char.encode()):
            return kind
    return OTHER


class Bpe:
    """Encoder of pre-tokens by the ranks of one file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        merges = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    merges[left, right] = rank
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "160MB", "temp_directory": "", "max_temp_directory_size": "0KB"})
        both = pa.array([a << 32 | b for a, b in merges], pa.int64())
        for name, table in (
            ("merges", pa.table({"ab": both, "rank": pa.array(merges.values(), pa.int64())})),
            ("vocabulary", pa.table({"id": pa.array(self.tokens, pa.int32()), "hex": [t.hex() for t in self.tokens.values()]})),
        ):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.encoder = WordEncoder(self.encode)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int] | None] = [[whole] if (whole := self.ranks.get(w)) is not None else self.by_heap(w) if len(w) > LONG_WORD else None for w in words]
        todo, rows = [], 0
        for k, found in enumerate(out):
            if found is None:
                if todo and rows + len(words[k]) > POSITIONS:
                    self._contract(words, todo, out)
                    todo, rows = [], 0
                todo.append(k)
                rows += len(words[k])
        if todo:
            self._contract(words, todo, out)
        return out

    def _contract(self, words: list[bytes], todo: list[int], out: list) -> None:
        lengths = np.array([len(words[k]) for k in todo])
        data = np.frombuffer(b"".join(words[k] for k in todo), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.db.register("symbols", pa.table({"k": np.repeat(np.array(todo, np.int64), lengths) << 20 | place, "id": self.bytes[data].astype(np.int64)}))
        found = self.db.sql(_ENCODE).to_arrow_table()
        self.db.unregister("symbols")
        for word, ids in zip(found.column("word").to_pylist(), found.column("ids").to_pylist(), strict=True):
            out[word] = ids

    def merged(self, left: int, right: int) -> int | None:
        return self.ranks.get(self.tokens[left] + self.tokens[right])

    def by_heap(self, word: bytes) -> list[int]:
        """The same contractions for a long word: neighbours wait in a heap by (rank, position)."""
        ids = [int(self.bytes[b]) for b in word]
        after, before, gone = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1)), [False] * len(ids)
        heap = [(r, k) for k in range(len(ids) - 1) if (r := self.merged(ids[k], ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if gone[k] or after[k] < 0 or self.merged(ids[k], ids[after[k]]) != rank:
                continue
            right = after[k]
            ids[k], gone[right], after[k] = rank, True, after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (r := self.merged(ids[left], ids[after[left]])) is not None:
                    heapq.heappush(heap, (r, left))
        return [i for i, g in zip(ids, gone, strict=True) if not g]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids; run ``k`` ends before ``ends[k]``."""
        lengths = np.diff(np.concatenate([np.zeros(1, np.int64), ends]))
        word, parts = np.repeat(np.arange(len(ends)), lengths), [[] for _ in ends]
        for at in range(0, len(ids), PIECE):
            piece = slice(at, at + PIECE)
            self.db.register("tokens", pa.table({"word": word[piece], "pos": np.arange(len(word[piece])), "id": ids[piece].astype(np.int32)}))
            for k, hexes in self.db.execute(_DECODE).fetchall():
                parts[k].append(bytes.fromhex(hexes))
            self.db.unregister("tokens")
        return [b"".join(p) for p in parts]


@lru_cache(maxsize=2)
def bpe_of(path: str) -> Bpe:
    return Bpe(path)


def _encode(bpe: Bpe, run: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of a run, ids of all of them, and where each text's ids start (one more at the end)."""
    data, offsets = buffers(run.column(text))
    starts, ends, first = split(data, offsets, probe)
    ids, counts = bpe.encoder(data, starts, ends)
    return data, offsets, ids, per_text(counts, first)


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encoded(df: DataFrame, text: str = "text", path: str = RANKS, into: str = "ids") -> DataFrame:
    """``df`` with ``array<int>`` ids of its texts; null texts have none."""
    df = new_columns(df, into)
    schema = df.withColumn(into, F.array().cast("array<int>")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        for batch in batches:
            for run in runs(batch, text, RUN_BYTES):
                _, _, ids, at = _encode(bpe, run, text)
                yield pa.RecordBatch.from_arrays([*run.columns, _lists(ids, at)], [*run.schema.names, into])

    return df.mapInArrow(add, schema)


def decoded(df: DataFrame, ids: str = "ids", path: str = RANKS, into: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids, by ordered aggregation in DuckDB; null ids give no bytes."""
    df = new_columns(df, into)
    schema = df.withColumn(into, F.lit(b"")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(ids).value_lengths().fill_null(0), np.int64))
            texts = bpe.decode(np.asarray(batch.column(ids).flatten()), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, into])

    return df.mapInArrow(add, schema)


def coded(df: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` and ``intact``: the ids decode to the text.  One worker does both ways."""
    df = new_columns(df, "n_tokens", "ids", "intact")
    schema = df.withColumns({"n_tokens": F.lit(0).cast("long"), "ids": F.array().cast("array<int>"), "intact": F.lit(True)}).schema

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        for batch in batches:
            for run in runs(batch, text, RUN_BYTES):
                data, offsets, ids, at = _encode(bpe, run, text)
                intact = [d == data[a:b].tobytes() for d, a, b in zip(bpe.decode(ids, at[1:]), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*run.columns, pa.array(np.diff(at)), _lists(ids, at), pa.array(intact, pa.bool_())], [*run.schema.names, "n_tokens", "ids", "intact"])

    return df.mapInArrow(both, schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """Digests of each text's ids and of the bytes they decode to."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        for batch in batches:
            for run in runs(batch, text, RUN_BYTES):
                _, _, ids, at = _encode(bpe, run, text)
                raw = ids.astype("<u4").tobytes()
                texts = bpe.decode(ids, at[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        run.column(key),
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(key, text).mapInArrow(digest, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, digested, and their decoding."""
    return round_trip(read(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
