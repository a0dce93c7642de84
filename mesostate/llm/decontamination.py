"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are put into classes by their number of five-word shingles.  A class
whose items have up to ``2 B`` shingles looks at each document through windows
of three blocks of ``B`` shingles, one window a block, so any run of ``2 B``
shingles lies whole in a window, and a window that holds 0.8 of an item has a
Jaccard similarity of at least 0.27 to it; with 32 hash functions, each a band
of its own, such an item is missed once in 20,000 times.  Items of at most eight
shingles are their own signature.  Candidates are verified on the shingles'
words: the item's distinct shingles found in the whole document, at least 0.8.

Items go to the executors in blocks of bounded size; a larger benchmark takes
more passes.  An item of fewer than five words is one shingle of all its words;
items and texts that are null or have no words match nothing.  Repeated rows are
searched one by one; an empty table on either side gives an empty result.  Texts
of any length are searched whole.  ``search`` reads no further columns; ``clean``
passes them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.llm.common import read
from mesostate.llm.textops import buffers, mix, ragged, range_hashes, runs, shingle_hashes, word_spans

SHINGLE = 5
LEAST = 0.8
HASHES = 32
#: Items of up to so many shingles are looked up shingle by shingle.
TINY = 8
#: Bytes of item text that go to the executors at once.
BLOCK_BYTES = 4 << 20

_MASKS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class Lookup:
    """Positions of values among a fixed set of 64-bit keys, with a bitmap in front."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.shift = np.uint64(64 - min(20, max(12, len(keys).bit_length() + 6)))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[self.keys >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each value that is a key, and the key's owner; one pair for each owner."""
        maybe = np.flatnonzero(self.bitmap[values >> self.shift])
        left = np.searchsorted(self.keys, values[maybe], "left")
        n = np.searchsorted(self.keys, values[maybe], "right") - left
        return np.repeat(maybe, n), self.owners[ragged(left, n)]


def shingles_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


@dataclass
class Index:
    """Signatures of one block of items."""

    ids: list
    shingles: list[set] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    tiny: dict[int, Lookup] = field(default_factory=dict)
    classes: list[tuple[int, list[Lookup]]] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[object, str | None]]) -> Index:
        kept = [(i, w) for i, t in items if (w := (t or "").encode().split())]
        self = cls([i for i, _ in kept])
        by_class: dict[int, list[int]] = {}
        tiny: dict[int, list[int]] = {}
        for at, (_, words) in enumerate(kept):
            size = min(SHINGLE, len(words))
            data = np.frombuffer(b" ".join(words), np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]))
            hashed = shingle_hashes(range_hashes(data, starts, ends), size)[: len(words) - size + 1]
            self.shingles.append(shingles_of(words, size))
            self.hashes.append(np.unique(hashed))
            self.sizes.append(size)
            n = len(self.hashes[-1])
            if n <= TINY:
                tiny.setdefault(size, []).append(at)
            else:
                by_class.setdefault((n - 1).bit_length() - 1, []).append(at)  # 2 ** (j + 1) >= n
        for size, members in tiny.items():
            owners = np.repeat(members, [len(self.hashes[m]) for m in members])
            self.tiny[size] = Lookup(np.concatenate([self.hashes[m] for m in members]), owners)
        for j, members in sorted(by_class.items()):
            minima = np.array([[(self.hashes[m] ^ c).min() for m in members] for c in _MASKS])
            self.classes.append((1 << j, [Lookup(row, np.array(members)) for row in minima]))
        return self

    def candidates(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sorted ``text * len(ids) + item`` of all pairs that share a signature value."""
        found = [np.zeros(0, np.int64)]
        n_words = np.diff(first)
        for size, lookup in self.tiny.items():
            counts = np.maximum(n_words - size + 1, 0)
            at, item = lookup.find(shingle_hashes(words, size)[ragged(first[:-1], counts)])
            found.append((np.searchsorted(np.cumsum(counts), at, "right")) * len(self.ids) + item)
        counts = np.maximum(n_words - SHINGLE + 1, 0)
        if self.classes and counts.sum():
            found += self._windows(shingle_hashes(words, SHINGLE), first[:-1], counts)
        return np.unique(np.concatenate(found))

    def _windows(self, shingles: np.ndarray, start: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        base = self.classes[0][0]
        blocks = -(-counts // base)
        block_text = np.repeat(np.arange(len(counts)), blocks)
        within = np.arange(len(block_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        # the last block of a text is filled up with its last shingle, which changes no minimum
        pick = np.minimum(within[None, :] * base + np.arange(base)[:, None], counts[block_text][None, :] - 1)
        columns = shingles[start[block_text][None, :] + pick]
        layers = []
        for b, lookups in self.classes:
            step = b // base
            starts = np.flatnonzero(within % step == 0)
            text = block_text[starts]
            one = np.append(text[1:] == text[:-1], False)
            two = np.append(text[2:] == text[:-2], [False] * min(2, len(text)))
            layers.append((lookups, starts, text, np.flatnonzero(one), np.flatnonzero(two), step))
        found = []
        for k, mask in enumerate(_MASKS):
            lowest = np.minimum.reduce(columns ^ mask, axis=0)
            for lookups, starts, text, one, two, step in layers:
                own = np.minimum.reduceat(lowest, starts) if step > 1 else lowest
                window = own.copy()
                window[one] = np.minimum(window[one], own[one + 1])
                window[two] = np.minimum(window[two], own[two + 2])
                at, item = lookups[k].find(window)
                if len(at):
                    found.append(text[at] * len(self.ids) + item)
        return found

    def matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shingles shared) of all rows that hold at least 0.8 of an item's shingles."""
        data, offsets = buffers(column)
        starts, ends, first = word_spans(data, offsets)
        words = range_hashes(data, starts, ends)
        out, at, own, exact = [], -1, None, {}
        for row, item in zip(*np.divmod(self.candidates(words, first), max(1, len(self.ids))), strict=True):
            size = self.sizes[item]
            if row != at:
                at, own, exact = row, {}, {}
            if size not in own:
                own[size] = np.unique(shingle_hashes(words[first[row] : first[row + 1]], size)[: max(0, first[row + 1] - first[row] - size + 1)])
            mine = own[size]
            place = np.minimum(np.searchsorted(mine, self.hashes[item]), len(mine) - 1) if len(mine) else None
            if place is None or (mine[place] == self.hashes[item]).sum() < LEAST * len(self.hashes[item]) - 1e-9:
                continue
            if size not in exact:
                exact[size] = shingles_of(data[offsets[row] : offsets[row + 1]].tobytes().split(), size)
            shared = len(self.shingles[item] & exact[size])
            if shared >= LEAST * len(self.shingles[item]) - 1e-9:
                out.append((int(row), int(item), shared))
        return out


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    """Indexes of blocks of items, each of bounded size; one is on the driver at a time."""
    total = items.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    n = -(-int(total) // BLOCK_BYTES)
    for block in range(n):
        rows = items.select(item_id, text)
        if n > 1:
            rows = rows.where(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == block)
        yield Index.of(sorted(((r[0], r[1]) for r in rows.collect()), key=lambda r: (r[0] is None, r[0], r[1] or "")))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs ``doc_id, item_id, shared, total`` of documents and the items they hold."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, shared int, total int"
    out = spark.createDataFrame([], kinds)
    for k, index in enumerate(item_blocks(items, item_id, item_text)):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for run in runs(batch):
                    if found := index.matches(run.column("text")):
                        rows, items, n = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [run.column("doc_id").take(pa.array(rows)), pa.array([index.ids[i] for i in items]), pa.array(n, pa.int32()), pa.array([len(index.shingles[i]) for i in items], pa.int32())],
                            ["doc_id", "item_id", "shared", "total"],
                        )

        found = source.mapInArrow(scan, kinds)
        out = found if k == 0 else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    out = docs
    for index in item_blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for run in runs(batch, text):
                    mask = np.ones(run.num_rows, bool)
                    mask[[m[0] for m in shared.value.matches(run.column(text))]] = False
                    yield run.filter(pa.array(mask))

        out = out.mapInArrow(keep, docs.schema)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Exact containment of each item in each document, over relations ``docs(doc_id, text)`` and ``benchmark``.
CONTAINED = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM docs),
b AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM b WHERE len(w) > 0))),
n AS (SELECT item_id, count(*) AS total FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT rid, doc_id, g FROM (SELECT rid, doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d))),
hit AS (SELECT rid, doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (g) GROUP BY rid, doc_id, item_id),
contained AS (SELECT doc_id, item_id, shared::INT AS shared, total::INT AS total FROM hit JOIN n USING (item_id) WHERE 10 * shared >= 8 * total)
"""

QUERIES = {"op10_decontamination": op10_decontamination}
SQL = {"op10_decontamination": f"WITH docs AS (SELECT doc_id, text FROM documents), {CONTAINED} SELECT doc_id, item_id, shared, total FROM contained"}
