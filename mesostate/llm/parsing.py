"""Removal of byte strings that occur twice, by prefix-free parsing of the corpus.

A rolling hash of eight bytes triggers the end of a phrase wherever it is 0 modulo ``FEW``
(modulo ``MANY`` where 200 bytes go without).  A string of 200 bytes is then a
suffix of a phrase, up to its first trigger, and the parse that follows.  Equal strings have their first trigger at
the same place, so they are neighbours in the order of (phrase suffix, parse).
Of that order only neighbours that agree in 200 bytes matter, so it is not
spelled out as ranks: it is refined by classes of equal prefixes, as when a
suffix array is built from buckets.

1. Strings of a phrase (a *context*: up to 96 starts in a row before one trigger) fall into a class by
   105 bytes that all of them have.  A context alone in its class holds nothing that occurs twice;
   one whose whole text recurs in its class is settled, all its strings occur twice.
2. Contexts that share a class with others of another text (a repeat begins or ends in
   them) are refined to 16 starts and 185 bytes, then to single strings.

A run of texts settles what it can by itself: what recurs within the run is
settled there and goes on as one row, and a class that the run has several times
goes on as one row with its members under their own keys, so no class, however common, has more than a row or two a run.
Classes are told apart by 128 bits.

Texts are bytes in UTF-8; a null text is empty.  Texts under 200 bytes keep all
their bytes.  Texts of any length are parsed in pieces that overlap.  Repeated rows
are copies of each other.  An empty table gives no rows.  Null ids are rows like
others; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.llm.common import drop, read, stored
from mesostate.llm.textops import buffers, mix, ragged, runs

#: Bytes of a string that may not occur twice.
LENGTH = 200
#: Bytes of the rolling hash.
GRAM = 8
#: A phrase ends where the rolling hash is 0 modulo the first number, or the second where no such place is near.
FEW, MANY = 64, 16
#: Starts of a context in each refinement of the order.
WIDTHS = (96, 16, 1)
#: Bytes that are hashed together, and of texts that a run settles by itself.
PIECE, RUN = 1 << 20, 8 << 20

_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
# flags of a row: it stands for two or more; its class is known to have others; it only stands for a class; it is settled
TWICE, KNOWN, CLASS, SETTLED = 1, 2, 4, 8
ROW = "key long, g long, doc long, place long"


@lru_cache(maxsize=2)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in _BASES:
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        out.append(tuple(both))
    return out


class Rolling:
    """Rolling hashes of all eight-byte strings of ``data``, and hashes of any range of eight bytes or more."""

    def __init__(self, data: np.ndarray):
        self.at = np.zeros(max(0, len(data) - GRAM + 1), np.uint64)
        for k in range(GRAM if len(self.at) else 0):
            self.at |= data[k : k + len(self.at)].astype(np.uint64) << np.uint64(8 * k)
        self.at = mix(self.at + np.uint64(0x9E3779B97F4A7C15))
        size = PIECE + 2 * LENGTH
        self.powers = _powers(size if len(data) <= size else 1 << int(len(data)).bit_length())
        self.sums = []
        for ahead, _ in self.powers:
            s = np.zeros(len(self.at) + 1, np.uint64)
            np.cumsum(self.at * ahead[: len(self.at)], out=s[1:])
            self.sums.append(s)

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return mix((s[ends - GRAM + 1] - s[starts]) * self.powers[which][1][starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def packed(start: np.ndarray, n: np.ndarray, far: np.ndarray, tag: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """First start, number of starts, distance of the first to its trigger, ten more bits of the document's key, flags."""
    return start << 32 | n << 24 | far << 16 | tag << 4 | flags


def unpacked(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 32, place >> 24 & 255, place >> 16 & 255, place >> 4 & 1023, place & 15


def contexts(hashes: Rolling, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts with the same first trigger: first start, number, distance of the first to the trigger.

    A start without any trigger in its string is a context of its own, at distance 0.
    """
    anchor, reach = np.full(len(starts), -1), LENGTH - GRAM
    for modulus, shift in ((FEW, 0), (MANY, 20)):
        there = (hashes.at >> np.uint64(shift)) % np.uint64(modulus) == 0
        before = np.cumsum(there) - there
        after = np.append(np.flatnonzero(there), 1 << 40)[before[starts]]
        anchor = np.where((anchor < 0) & (after - starts <= reach), after, anchor)
    anchor = np.where(anchor < 0, starts, anchor)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(starts, prepend=-1) != 1))
    return starts[new], np.diff(np.append(new, len(starts))), anchor[new] - starts[new]


def split(start: np.ndarray, n: np.ndarray, far: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts cut where the distance to the trigger is a multiple of ``width``, and of which context each part is."""
    first = far // width
    parts = first - (far - n + 1) // width + 1
    of = np.repeat(np.arange(len(start)), parts)
    band = first[of] - ragged(np.zeros(len(parts), np.int64), parts)
    high = np.minimum(far[of], band * width + width - 1)
    low = np.maximum((far - n + 1)[of], band * width)
    return start[of] + far[of] - high, high - low + 1, high, of


def classed(hashes: Rolling, start: np.ndarray, n: np.ndarray, far: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of what all strings of a context's class have in common, and of the context's whole text."""
    low = far // width * width
    high = np.minimum(low + width - 1, LENGTH - GRAM)
    trigger = start + far
    return hashes.of(trigger - low, trigger - high + LENGTH, 0), hashes.of(start, start + n - 1 + LENGTH, 1)


def settled_here(key: np.ndarray, g: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a run as they go on, and which row each came from (-1: it stands for a class)."""
    order = np.lexsort((g, key))
    key, g, doc, place = key[order], g[order], doc[order], place[order]
    new_key = np.diff(key, prepend=key[:1] - 1 if len(key) else 0) != 0
    new = new_key | (np.diff(g, prepend=g[:1] - 1 if len(g) else 0) != 0)
    sub = np.cumsum(new) - 1
    group = np.cumsum(new_key) - 1
    size = np.bincount(sub)
    kinds = np.bincount(group[new]) if len(key) else np.zeros(0, int)
    many = size[sub] > 1
    flags = np.where(new, np.where(many, TWICE, 0) | np.where(kinds[group] > 1, KNOWN, 0), SETTLED)
    known = (flags & KNOWN) > 0
    stands = np.flatnonzero(new_key & (kinds[group] > 1))
    out_key = np.where(flags == SETTLED, mix((doc ^ place).view(np.uint64)).view(np.int64), np.where(known, g, key))
    out_g = np.where(known, key, g)
    none = np.zeros(len(stands), np.int64)
    return (
        np.concatenate([out_key, key[stands]]), np.concatenate([out_g, ~key[stands]]), np.concatenate([doc, none]),
        np.concatenate([place | flags, none + (TWICE | CLASS)]), np.concatenate([order, none - 1]),
    )


def judged(key: np.ndarray, g: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows ordered by both hashes: which are settled, which go on to the next refinement, and which of these stand for two or more."""
    if not len(key):
        return (np.zeros(0, bool),) * 3
    flags = place & 15
    done = (flags & SETTLED) > 0
    new_key = np.append(True, key[1:] != key[:-1])
    new = new_key | np.append(True, g[1:] != g[:-1])
    group, sub = np.cumsum(new_key) - 1, np.cumsum(new) - 1
    weight = 1 + (flags & TWICE)
    in_group, in_sub = np.bincount(group, weight), np.bincount(sub, weight)
    known = np.bincount(group, flags & KNOWN) > 0
    ref = (flags & (CLASS | SETTLED)) == 0
    whole = ref & (in_sub[sub] > 1)
    open_ = ref & (known[group] | ((in_group[group] > 1) & (np.bincount(group[new])[group] > 1))) & (new | ~whole)
    return done | whole, open_, whole


def blocks(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.Table]:
    """Batches ordered by ``key``, joined and cut so that all rows of a key are in one block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[0].column(key)[0] != batch.column(key)[-1]:
            values = batch.column(key).to_numpy()
            last = values[-1]
            cut = int(np.searchsorted(values, last))
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().astype(np.int64) for n in names]


def _batch(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of all texts (``doc, tag, text``), settled within each run."""
    for batch in batches:
        for run in runs(batch, most=RUN):
            doc, tag = _numbers(run, "doc", "tag")
            _, first, copies = np.unique(np.stack([doc, tag]), axis=1, return_index=True, return_counts=True)
            run, doc, tag = run.take(pa.array(first)), doc[first], tag[first]
            data, offsets = buffers(run.column("text"))
            rows = []
            for at in range(0, len(data), PIECE):
                to = min(at + PIECE, len(data))
                texts = np.arange(np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, to))
                low, high = np.maximum(offsets[texts], at), np.minimum(offsets[texts + 1] - LENGTH + 1, to)
                starts = ragged(low - at, np.maximum(high - low, 0))
                if not len(starts):
                    continue
                hashes = Rolling(data[at : to + LENGTH])
                start, n, far, _ = split(*contexts(hashes, starts), WIDTHS[0])
                text = np.searchsorted(offsets, start + at, "right") - 1
                key, g = classed(hashes, start, n, far, WIDTHS[0])
                rows.append((key, g, doc[text], packed(start + at - offsets[text], n, far, tag[text], np.zeros_like(n)), copies[text]))
            if not rows:
                continue
            key, g, where, place, copies_ = (np.concatenate(c) for c in zip(*rows, strict=True))
            key, g, where, place, _ = settled_here(*_twice(key, g, where, place, copies_ > 1))
            yield _batch(key=key, g=g, doc=where, place=place)


def _twice(key: np.ndarray, g: np.ndarray, doc: np.ndarray, place: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of texts that the run has more than once, put in twice."""
    again = np.flatnonzero(twice)
    return tuple(np.concatenate([c, c[again]]) for c in (key, g, doc, place))


def _first_judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, place, goes_on`` of settled contexts and of those to be refined."""
    for block in blocks(batches):
        key, g, doc, place = _numbers(block, "key", "g", "doc", "place")
        done, on, twice = judged(key, g, place)
        flags = np.where(twice, TWICE, 0)
        bare = place & ~15
        yield _batch(
            doc=np.concatenate([doc[done], doc[on]]), tag=np.concatenate([bare[done], bare[on]]) >> 4 & 1023,
            place=np.concatenate([bare[done], (bare | flags)[on]]), goes_on=np.repeat([False, True], [done.sum(), on.sum()]),
        )


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Narrow contexts with their texts, from documents (``doc, text, places``); of copies side by side, two stand for all."""
    before = ()
    for batch in batches:
        for row in range(batch.num_rows):
            name = (batch.column("doc")[row].as_py(), batch.column("tag")[row].as_py())
            if before == (name, name):
                continue
            before = (*before, name)[-2:]
            data = np.frombuffer(batch.column("text")[row].as_py(), np.uint8)
            place = np.unique(batch.column("places")[row].values.to_numpy())
            start, n, far, tag, flags = unpacked(place)
            start, n, far, of = split(start, n, far, WIDTHS[1])
            bodies = data[ragged(start, n - 1 + LENGTH)].tobytes()
            ends = np.cumsum(n - 1 + LENGTH)
            hashes = Rolling(np.frombuffer(bodies, np.uint8))
            key, g = classed(hashes, ends - (n - 1 + LENGTH), n, far, WIDTHS[1])
            yield _batch(
                key=key, g=g, doc=np.full(len(n), name[0]), place=packed(start, n, far, tag[of], flags[of]),
                body=pa.array([bodies[e - k : e] for e, k in zip(ends.tolist(), (n - 1 + LENGTH).tolist(), strict=True)], pa.binary()),
            )


def _second_judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled contexts, and single strings of those that are still open."""
    for block in blocks(batches):
        key, g, doc, place = _numbers(block, "key", "g", "doc", "place")
        done, on, twice = judged(key, g, place)
        bare = place & ~15
        yield _batch(key=key[done], g=g[done], doc=doc[done], place=bare[done] | SETTLED)
        on = np.flatnonzero(on)
        if not len(on):
            continue
        bodies = pa.concat_arrays(block.column("body").take(pa.array(on)).chunks)
        data, offsets = buffers(bodies)
        start, n, _, tag, _ = unpacked(place[on])
        of = np.repeat(np.arange(len(on)), n)
        step = ragged(np.zeros(len(on), np.int64), n)
        hashes = Rolling(data)
        at = offsets[of] + step
        rows = (hashes.of(at, at + LENGTH, 0), hashes.of(at, at + LENGTH, 1), doc[on][of], packed(start[of] + step, np.ones_like(of), np.zeros_like(of), tag[of], np.zeros_like(of)))
        key, g, where, place_, _ = settled_here(*_twice(*rows, twice[on][of]))
        yield _batch(key=key, g=g, doc=where, place=place_)


def _last_judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        key, g, doc, place = _numbers(block, "key", "g", "doc", "place")
        done = judged(key, g, place)[0]
        yield _batch(doc=doc[done], tag=place[done] >> 4 & 1023, place=place[done] & ~15)


def repeated(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``doc, tag, place`` of all starts of strings that occur twice, from ``doc, tag, text``; and stored tables to drop after use."""
    spark = docs.sparkSession
    sorted_by_class = lambda df: df.repartition("key").sortWithinPartitions("key", "g")
    first, one = stored(sorted_by_class(docs.mapInArrow(_parsed, ROW)).mapInArrow(_first_judged, "doc long, tag long, place long, goes_on boolean"), "contexts")
    on, three = stored(first.where("goes_on").groupBy("doc", "tag").agg(F.collect_list("place").alias("places")), "open-contexts")
    narrow = docs.join(on, ["doc", "tag"]).select("doc", "tag", "text", "places").mapInArrow(_refined, f"{ROW}, body binary")
    second, two = stored(sorted_by_class(narrow).mapInArrow(_second_judged, ROW), "strings")
    last = sorted_by_class(second).mapInArrow(_last_judged, "doc long, tag long, place long")
    return first.where("NOT goes_on").drop("goes_on").unionByName(last), [one, two, three]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text (``text, places``): number of bytes, removed bytes and runs, the rest."""
    for batch in batches:
        n_bytes, removed, spans, rest = [], [], [], []
        for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
            text = text.as_py()
            gone = np.zeros(len(text) + 1, np.int32)
            if places.is_valid:
                start, n, *_ = unpacked(places.values.to_numpy())
                np.add.at(gone, start, 1)
                np.add.at(gone, start + n - 1 + LENGTH, -1)
            gone = np.cumsum(gone)[:-1] > 0
            n_bytes.append(len(text))
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(text) else 0)
            rest.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if removed[-1] else text)
        kept = [n for n in batch.schema.names if n not in ("text", "places")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(rest, pa.binary())], [*kept, "n_bytes", "n_removed", "n_spans", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        digest = pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in batch.column("kept")], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], digest], [*batch.schema.names[:-1], "kept_sha256"])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and the bytes that are ``kept``, or with ``digest`` their checksum ``kept_sha256``."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("doc"), F.pmod(F.xxhash64(F.lit(1), body), F.lit(1024)).alias("tag"), body.cast("binary").alias("text"))
    places, paths = repeated(keyed.select("doc", "tag", "text"))
    listed, path = stored(places.groupBy("doc", "tag").agg(F.collect_set("place").alias("places")), "places")
    drop(spark, *paths)
    step: Callable = _digested if digest else _cut
    kinds = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")
    found, _ = stored(keyed.join(listed, ["doc", "tag"], "left").select("doc_id", "text", "places").mapInArrow(step, kinds), "deduplicated")
    drop(spark, path)
    return found


def op13_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses of strings of 200 bytes that occur twice, and a checksum of what it keeps."""
    return deduplicated(read(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op13_deduplication": op13_deduplication}
#: Bytes are pairs of hexadecimal digits; every string of 200 bytes is told from others by its MD5.
SQL = {
    "op13_deduplication": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
u AS (SELECT rid, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
k AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM u)),
s AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY rid, k),
p AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS c FROM s),
t AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM p JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN t USING (rid)"""
}
