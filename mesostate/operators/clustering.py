"""Cluster centres for many starts at once, as starting points of state models.

Centres are chosen by oversampling rows by their cost, weighting and reducing the
sample, and moving centres to the means of their rows.  Every pass over the rows
serves all starts that are still moving, so the number of jobs depends on the
slowest start and not on how many there are.  What reaches the driver is bounded
by starts, centres and dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesostate.operators.models import WORTH, as_matrix, co_moments
from mesostate.storage import checkpoint

#: Rows drawn a round for each centre that is asked for, and rounds.
OVERSAMPLE, ROUNDS = 2, 5


@dataclass
class Centres:
    """Centres (a row each), the sum of squared distances to them, passes until they stood still."""

    points: np.ndarray
    cost: float
    passes: int = 0


def squared_distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """A row a row of ``x`` and a column a point, from differences, so that nothing cancels."""
    return np.stack([((x - p) ** 2).sum(axis=1) for p in points], axis=1)


def uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """A number in 0..1 of each row that depends on its values and the seed alone."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    total = np.full(len(x), (seed * 0x9E3779B97F4A7C15 + 1) % 2**64, np.uint64)
    for column in bits.T:
        total = (total ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
        total *= np.uint64(0x94D049BB133111EB)
        total ^= total >> np.uint64(32)
    return ((total >> np.uint64(11)).astype(float) + 0.5) / 2**53


def _packed(rows: DataFrame, n: int, centre: np.ndarray, x: str) -> DataFrame:
    """``obs, once``: the ``n`` rows less ``centre`` as bytes, a batch in one, and which of them are the first of equal ones of their batch.

    Made once, in at most as many partitions as there are cores, so no pass takes lists apart or sorts rows again, and the driver gets a row a partition.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = as_matrix(batch.column("x")) - centre
                once = np.zeros(len(m), bool)
                once[np.unique(m, axis=0, return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()]), pa.array([once.tobytes()])], ["obs", "once"])

    packed = rows.select(F.col(x).alias("x")).mapInArrow(pack, "obs binary, once binary")
    return checkpoint(packed.repartition(min(rows.sparkSession.sparkContext.defaultParallelism, 1 + n * len(centre) // WORTH)))


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for obs, once in zip(batch.column("obs"), batch.column("once"), strict=True):
            yield np.frombuffer(obs.as_buffer()).reshape(-1, width), np.frombuffer(once.as_buffer(), bool)


def _least(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` distinct rows of the least keys, which depend on the rows alone; ties by the rows."""
    first = np.lexsort((*rows.T, keys))
    keys, rows = keys[first], rows[first]
    new = np.append(np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(axis=1))
    return keys[new][:n], rows[new][:n]


def _drawn(packed: DataFrame, points: list[np.ndarray | None], n: int, seeds: list[int], width: int) -> list[np.ndarray]:
    """``n`` distinct rows for each start, drawn by their squared distance to its points (by chance alone without points)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros((0, width)))] * len(points)
        for rows, once in _unpacked(batches, width):
            m = rows[once]
            for r, known in enumerate(points):
                weight = np.ones(len(m)) if known is None else squared_distances(m, known).min(axis=1)
                with np.errstate(divide="ignore"):
                    key = np.where(weight > 0, -np.log(uniform(m, seeds[r])) / weight, np.inf)
                some = np.flatnonzero(key <= np.partition(key, n - 1)[n - 1]) if len(key) > n else np.arange(len(key))
                some = some[np.isfinite(key[some])]
                best[r] = _least(np.append(best[r][0], key[some]), np.concatenate([best[r][1], m[some]]), n)
        for r, (keys, held) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([keys.tobytes()]), pa.array([held.tobytes()])], ["r", "keys", "held"])

    found = packed.mapInArrow(draw, "r int, keys binary, held binary").collect()
    out = []
    for r in range(len(points)):
        own = [f for f in found if f["r"] == r]
        keys = np.concatenate([np.zeros(0), *[np.frombuffer(f["keys"]) for f in own]])
        held = np.concatenate([np.zeros((0, width)), *[np.frombuffer(f["held"]).reshape(-1, width) for f in own]])
        kept = _least(keys, held, n)[1]
        out.append(kept[np.lexsort(kept.T[::-1])])
    return out


def _assigned(packed: DataFrame, points: list[np.ndarray], width: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each start: how many rows are nearest to each point, their sums, and the cost."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for m, _ in _unpacked(batches, width):
            parts = []
            for p in points:
                d = squared_distances(m, p)
                near = d.argmin(axis=1)
                sums = np.stack([np.bincount(near, column, len(p)) for column in m.T], axis=1)
                parts += [np.bincount(near, minlength=len(p)).astype(float), sums.ravel(), [d[np.arange(len(m)), near].sum()]]
            parts = np.concatenate(parts)
            total = parts if total is None else total + parts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["v"])

    v = np.sum([np.frombuffer(r["v"]) for r in packed.mapInArrow(assign, "v binary").collect()], axis=0)
    out, at = [], 0
    for p in points:
        n, s = len(p), p.size
        out.append((v[at : at + n], v[at + n : at + n + s].reshape(p.shape), float(v[at + n + s])))
        at += n + s + 1
    return out


def reduced(points: np.ndarray, weight: np.ndarray, k: int, seed: int, tries: int = 8) -> np.ndarray:
    """``k`` centres of weighted points in memory: the best of some greedy starts moved until they stand still."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(tries):
        chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
        near = squared_distances(points, points[chosen]).min(axis=1)
        while len(chosen) < k and (near * weight).sum() > 0:
            chosen.append(int(rng.choice(len(points), p=near * weight / (near * weight).sum())))
            near = np.minimum(near, squared_distances(points, points[chosen[-1:]])[:, 0])
        centres = points[chosen].copy()
        for _ in range(100):
            d = squared_distances(points, centres)
            own = d.argmin(axis=1)
            mass = np.bincount(own, weight, len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, own, points * weight[:, None])
            moved = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
            if np.array_equal(moved, centres):
                break
            centres = moved
        cost = float((squared_distances(points, centres).min(axis=1) * weight).sum())
        if best is None or cost < best[0]:
            best = cost, centres
    return best[1]


def k_means(rows: DataFrame, k: int, seeds: list[int] = (42,), x: str = "x", most: int = 50, tol: float = 1e-6, known: tuple | None = None) -> list[Centres]:
    """Centres of the arrays in ``x`` for each seed, in the order of the seeds (M4).

    A start draws ``OVERSAMPLE * k`` rows in each of ``ROUNDS`` rounds, weights all of them by the rows that are nearest, reduces
    them to ``k``, and then takes the means of the nearest rows until the cost falls by less than ``tol`` of itself.
    Equal rows count as one when rows are drawn and each by itself in weights and means.  With fewer than ``k`` distinct rows
    there are as many centres as distinct rows.  ``rows`` is read once, and once more without ``known``, which is what
    ``co_moments`` says of the rows.
    """
    n, centre, _ = known or co_moments(rows, x)
    if not n:
        raise ValueError("nothing to cluster")
    width = len(centre)
    less = _packed(rows, n, centre, x)
    drawn: list[np.ndarray | None] = [None] * len(seeds)
    for turn in range(ROUNDS + 1):
        new = _drawn(less, drawn, OVERSAMPLE * k if turn else 1, [seed * (ROUNDS + 1) + turn for seed in seeds], width)
        drawn = [a if b is None else np.concatenate([b, a]) if len(a) else b for a, b in zip(new, drawn, strict=True)]
    starts = [reduced(p, w, k, seed) for p, (w, _, _), seed in zip(drawn, _assigned(less, drawn, width), seeds, strict=True)]
    out = [Centres(p, np.inf) for p in starts]
    moving = list(range(len(seeds)))
    for _ in range(most):
        found = _assigned(less, [out[r].points for r in moving], width)
        still = []
        for r, (weight, sums, cost) in zip(moving, found, strict=True):
            gain = out[r].cost - cost
            out[r] = Centres(np.where(weight[:, None] > 0, sums / np.maximum(weight, 1)[:, None], out[r].points), cost, out[r].passes + 1)
            if gain > tol * cost:
                still.append(r)
        moving = still
        if not moving:
            break
    return [Centres(c.points + centre, c.cost, c.passes) for c in out]


def assigned(rows: DataFrame, centres: np.ndarray, x: str = "x", into: str = "cluster") -> DataFrame:
    """``rows`` with the number of the nearest centre, the least on ties."""
    def distance(p: np.ndarray) -> Callable:
        return F.aggregate(F.zip_with(x, F.lit(p.tolist()).cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    d = F.array(*[distance(p) for p in centres])
    return rows.withColumn(into, F.transform(F.array(d), lambda a: F.array_position(a, F.array_min(a)) - 1)[0].cast("int"))
