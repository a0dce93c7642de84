"""Whitening of embeddings from exact integer cross-products of bit planes.

Entries become whole numbers ``floor(64 c) + 1000000``.  The fit counts each
distinct vector once.  A task shifts each dimension by its own least value,
cuts what is left into bit planes and packs a plane's bits across rows into
words; the weighted popcounts of ``plane AND plane`` are the exact cross-products.
Tasks emit them as limbs of 32 bits, one number a pair of dimensions and limb, which
Spark adds up, so neither rows nor anything that grows with them reaches the
driver: it gets ``D x D`` numbers.  They are centred as whole numbers before they
become doubles, and the eigenvectors are refined in extended precision.

Rows whose vector is null, empty, or has a null, non-finite or too large entry
(one without a whole number in a long) are left out.  Vectors of different
lengths raise an error.  Null ids and repeated rows keep rows of their own; of
equal eigenvalues any basis is given.  Components without variance, or with less
of it than extended precision tells from none (about 1e-17 of the greatest), are left out, so a table of one distinct vector, like an empty one, gives no rows.  Further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.llm.common import drop, read, stored
from mesostate.operators.models import co_moments

SCALE, SHIFT = 64, 1_000_000
#: Largest number of components that are returned.
COMPONENTS = 16
#: Rows whose planes are packed at once: 128 words a plane.
BLOCK = 8192
LIMB = 32
_MOST = 2.0**62


def whole(vector: Column) -> Column:
    """The vector as whole numbers, or null where it has none."""
    fine = lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < _MOST)  # noqa: E731  (null, NaN and infinity fail)
    numbers = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return F.when((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(fine(c) & ~F.isnan(c.cast("double")), F.lit(False))), numbers)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bit planes of the columns of non-negative whole numbers: words, and the dimension and weight of each plane."""
    words, dims, weights = [], [], []
    for d in range(x.shape[1]):
        for bit in range(int(x[:, d].max()).bit_length()):
            packed = np.packbits(((x[:, d] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8))
            words.append(np.frombuffer(np.pad(packed, (0, -len(packed) % 8)).tobytes(), np.uint64))
            dims.append(d)
            weights.append(bit)
    return np.array(words, np.uint64).reshape(len(dims), -(-len(x) // 64)), np.array(dims, np.int64), np.array(weights, np.int64)


def cross_products(x: np.ndarray) -> list[list[int]]:
    """Exact ``X^T X`` of non-negative whole numbers, by popcounts of pairs of planes."""
    size = x.shape[1]
    words, dims, weights = planes(x)
    count = np.zeros((size, size, 2 * int(weights.max(initial=0)) + 1), np.int64)
    for p in range(len(dims)):
        both = np.bitwise_count(words[p:] & words[p]).sum(axis=1, dtype=np.int64)
        np.add.at(count, (dims[p], dims[p:], weights[p] + weights[p:]), both)
        if p + 1 < len(dims):  # the other order of two planes of one dimension
            same = np.flatnonzero(dims[p + 1 :] == dims[p]) + 1
            np.add.at(count, (dims[p], dims[p], weights[p] + weights[p + same]), both[same])
    out = [[0] * size for _ in range(size)]
    for i, j, w in zip(*(a.tolist() for a in np.nonzero(count)), strict=True):
        out[i][j] += int(count[i, j, w]) << w
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, sums and cross-products of a task's vectors around ``SHIFT``, in limbs: row 0 has the sums, and ``(0, 0)`` the number."""
    total: list[list[int]] | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            x = matrix(batch.column(0).slice(at, BLOCK))
            if total is None:
                total = [[0] * (x.shape[1] + 1) for _ in range(x.shape[1] + 1)]
            low = x.min(axis=0)
            up = (x - low).view(np.uint64)
            cross = cross_products(up)
            n, s, low = len(x), [int(v) for v in up.astype(object).sum(axis=0)], [int(v) - SHIFT for v in low]
            total[0][0] += n
            for i in range(len(low)):
                total[0][i + 1] += s[i] + n * low[i]
                for j in range(i, len(low)):
                    total[i + 1][j + 1] += cross[i][j] + low[i] * s[j] + s[i] * low[j] + n * low[i] * low[j]
    if total is None:
        return
    rows = []
    for i, line in enumerate(total):
        for j in range(i, len(line)):
            value, limb = line[j], 0
            while value >> (LIMB - 1) not in (0, -1):
                rows.append((i, j, limb, value & (2**LIMB - 1)))
                value, limb = value >> LIMB, limb + 1
            rows.append((i, j, limb, value))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "limb", "v"])


def exact_sums(vectors: DataFrame, x: str) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and cross-products around ``SHIFT`` of whole vectors of one length, exactly."""
    cells = vectors.select(x).mapInArrow(_sums, "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v")).collect()
    size = max((r["j"] for r in cells), default=0)
    total = [[0] * (size + 1) for _ in range(size + 1)]
    for r in cells:
        total[r["i"]][r["j"]] += r["v"] << (LIMB * r["limb"])
    for i in range(size + 1):
        for j in range(i):
            total[i][j] = total[j][i]
    return total[0][0], total[0][1:], [line[1:] for line in total[1:]]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix of extended precision.

    The double solution is refined by first-order corrections until small eigenvalues beside large ones are right too.
    """
    values, x = np.linalg.eigh(v.astype(float))
    x = x.astype(np.longdouble)
    for _ in range(3):
        r = np.eye(len(v)) - x.T @ x
        s = x.T @ v @ x
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        off = s - np.diag(values)
        near = np.abs(gap) <= 2 * (np.linalg.norm(off.astype(float), 2) + float(np.abs(v).max()) * np.linalg.norm(r.astype(float), 2))
        x = x + x @ np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


@dataclass
class Whitening:
    """Number, sums around ``SHIFT``, components (a row each), their eigenvalues and shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """``n x - S`` of each entry, exactly: longs where they are small enough, Python's numbers otherwise."""
        x = x - SHIFT
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * (most + 1) + max(map(abs, self.sums)) >= 1 << 51:
            x = x.astype(object)
        return self.n * x - np.array(self.sums, x.dtype)

    def deviations(self, gaps: np.ndarray) -> list[int]:
        """Sums of squares of each row, exactly."""
        if gaps.dtype == object:
            return (gaps * gaps).sum(axis=1).tolist()
        high, low = gaps >> 26, gaps & (2**26 - 1)  # under 2**26 each, so sums over 1024 dimensions fit
        parts = [np.zeros((3, len(gaps)), object)]
        for at in range(0, gaps.shape[1], 1024):
            h, w = high[:, at : at + 1024], low[:, at : at + 1024]
            parts.append(np.stack([(h * h).sum(axis=1), (h * w).sum(axis=1), (w * w).sum(axis=1)]).astype(object))
        a, b, c = sum(parts)
        return (a * 2**52 + b * 2**27 + c).tolist()

    def project(self, gaps: np.ndarray) -> np.ndarray:
        """Whitened rows, a column a component."""
        return (gaps / self.n).astype(float) @ (self.components / np.sqrt(self.values)[:, None]).T.astype(float)


def fit(vectors: DataFrame, x: str, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct whole vectors; None where nothing varies."""
    n, s, c = exact_sums(vectors, x)
    if n < 2:
        return None
    centred = [[n * c[i][j] - s[i] * s[j] for j in range(len(s))] for i in range(len(s))]
    trace = sum(centred[i][i] for i in range(len(s)))
    if not trace:
        return None
    high = np.array([[float(Fraction(v, n * n)) for v in line] for line in centred])
    rest = np.array([[float(Fraction(v, n * n) - Fraction(high[i, j])) for j, v in enumerate(line)] for i, line in enumerate(centred)])
    values, vectors_ = eigen(high.astype(np.longdouble) + rest)
    kept = (values > values[0] * len(s) * np.finfo(np.longdouble).eps * 64)[:most].nonzero()[0]
    total = np.longdouble(float(Fraction(trace, n * n)))
    return Whitening(n, s, vectors_[:, kept].T, values[kept], (values[kept] / total).astype(float))


def whitened(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, exact_deviation`` for each row and component.

    ``deviation`` is null where it does not fit a long; ``exact_deviation`` has it as text in any case.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).alias("vec_id"), whole(F.col(embedding)).alias("x")).where("x IS NOT NULL")
    kinds = f"vec_id {df.schema[vec_id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, exact_deviation string"
    distinct, path = stored(rows.select("x").distinct(), "vectors")
    lengths = [r[0] for r in distinct.select(F.size("x")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths")
    model = fit(distinct, "x", most) if lengths else None
    if model is None:
        drop(spark, path)
        return spark.createDataFrame([], kinds)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(model.project(model.gaps(matrix(batch.column(0))))))], ["w"])

    _, _, moments = co_moments(distinct.mapInArrow(project, "w array<double>"), "w")
    error = float(np.abs(moments / model.n - np.eye(len(model.values))).max())
    drop(spark, path)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            gaps = model.gaps(matrix(batch.column("x")))
            deviation = model.deviations(gaps)
            each = np.repeat(np.arange(len(deviation)), k)
            columns = [
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(deviation))), pa.array(np.full(len(each), model.n)),
                pa.array([v if v < 2**63 else None for v in deviation], pa.int64()).take(pa.array(each)), pa.array(model.project(gaps).ravel()),
                pa.array(np.tile(model.explained, len(deviation))), pa.array(np.full(len(each), error)), pa.array([str(v) for v in deviation]).take(pa.array(each)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "exact_deviation"])

    return rows.mapInArrow(transform, kinds)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, 16 components at most."""
    return whitened(read(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
SQL: dict[str, str] = {}
