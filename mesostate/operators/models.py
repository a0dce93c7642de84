"""Principal components and Gaussian hidden Markov models, fitted and applied as Spark jobs.

What reaches the driver is bounded by dimensions and states, never by rows: a
Gramian of ``D x D`` numbers, or expected counts of ``K x K`` and ``K x D``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.storage import checkpoint

TINY = 1e-300
#: Groups of partitions whose moments are merged on executors; as many matrices reach the driver.
MERGED = 8


def merged(a: tuple | None, b: tuple) -> tuple:
    """Number, mean and co-moments about it of two disjoint sets of rows together."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def as_matrix(column: pa.ListArray) -> np.ndarray:
    """The arrays of a column as rows of doubles; all must be there and equally long."""
    lengths = pc.list_value_length(column)
    if column.null_count or pc.min(lengths) != pc.max(lengths):
        raise ValueError("arrays are missing or differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def co_moments(rows: DataFrame, x: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and ``sum (x - mean)(x - mean)^T`` of the arrays in ``x``.

    Each batch is centred at its own mean before it is multiplied, and sets are merged by the gap of their means, so an
    offset of all rows costs no precision.  Partitions are merged in ``MERGED`` groups on executors, then on the driver.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = as_matrix(batch.column(x))
                mean = m.mean(axis=0)
                mean += (m - mean).mean(axis=0)
                total = merged(total, (len(m), mean, (m - mean).T @ (m - mean)))
        if total is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"n": [total[0]], "mean": [total[1]], "c": [total[2].ravel()]}), preserve_index=False)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for n, mean, c in zip(batch["n"], batch["mean"], batch["c"], strict=True):
                total = merged(total, (n, np.array(mean), np.reshape(c, (len(mean), len(mean)))))
        if total is not None:
            yield pd.DataFrame({"n": [total[0]], "mean": [total[1]], "c": [total[2].ravel()]})

    kind = "n long, mean array<double>, c array<double>"
    parts = rows.select(x).mapInArrow(part, kind).repartition(MERGED).mapInPandas(merge, kind).toPandas()
    found = next(merge(iter([parts])), None)
    if found is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    size = len(found["mean"][0])
    return int(found["n"][0]), np.array(found["mean"][0]), np.reshape(found["c"][0], (size, size))


@dataclass
class Components:
    """Mean, loadings (a row a component) and explained shares."""

    mean: np.ndarray
    loadings: np.ndarray
    ratio: np.ndarray
    all_ratio: np.ndarray

    def curve(self, spark: SparkSession) -> DataFrame:
        """``component, ratio, cumulative`` of all components, kept or not."""
        rows = [(k, float(r), float(c)) for k, (r, c) in enumerate(zip(self.all_ratio, np.cumsum(self.all_ratio), strict=True))]
        return spark.createDataFrame(rows, "component int, ratio double, cumulative double")

    def transform(self, rows: DataFrame, x: str = "x", into: str = "pc") -> DataFrame:
        def dot(row: np.ndarray, shift: float) -> Column:
            weights = F.lit(row.tolist()).cast("array<double>")
            return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(-shift), lambda s, v: s + v)

        return rows.withColumn(into, F.array(*[dot(w, float(w @ self.mean)) for w in self.loadings]))


def principal_components(rows: DataFrame, share: float = 0.9, x: str = "x") -> Components:
    """Fewest components that explain over ``share`` of the variance; the largest loading of each is positive."""
    n, mean, moments = co_moments(rows, x)
    if n < 2:
        raise ValueError("principal components need at least two rows")
    values, vectors = np.linalg.eigh(moments / (n - 1))
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    ratio = values / max(values.sum(), TINY)
    k = min(int(np.searchsorted(np.cumsum(ratio), share, "right")) + 1, len(ratio))
    return Components(mean, vectors[:k], ratio[:k], ratio)


@dataclass
class Hmm:
    """Start and transition probabilities, means and covariances of ``K`` states; log-likelihood of each step of the fit, and whether it converged.

    ``var`` has a row a state of variances (``diag``), a matrix a state (``full``), or one matrix for all (``tied``).
    """

    start: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    history: tuple[float, ...] = ()
    converged: bool = False
    covariance: str = "diag"

    def log_density(self, obs: np.ndarray) -> np.ndarray:
        if self.covariance == "diag":
            return np.stack([-0.5 * (((obs - m) ** 2 / v).sum(axis=1) + np.log(2 * np.pi * v).sum()) for m, v in zip(self.mean, self.var, strict=True)], axis=1)
        out = np.empty((len(obs), len(self.mean)))
        lower = np.linalg.cholesky(self.var)
        for k, mean in enumerate(self.mean):
            own = lower[k] if self.covariance == "full" else lower
            gap = (obs - mean) @ np.linalg.inv(own).T
            out[:, k] = -0.5 * ((gap**2).sum(axis=1) + len(mean) * np.log(2 * np.pi)) - np.log(np.diag(own)).sum()
        return out

    def record(self, spark: SparkSession) -> DataFrame:
        """How the fit went, in one row (M7): whether and when it converged, its last gain, all log-likelihoods."""
        h = [float(v) for v in self.history]
        row = (self.converged, len(h), h[-1] - h[-2] if len(h) > 1 else None, h)
        return spark.createDataFrame([row], "converged boolean, n_iter int, delta_final double, log_likelihoods array<double>")

    def transitions(self, spark: SparkSession) -> DataFrame:
        """``i, j, p`` of the model's transition matrix (SNK12)."""
        k = len(self.step)
        return spark.createDataFrame([(i, j, float(self.step[i, j])) for i in range(k) for j in range(k)], "i int, j int, p double")

    def forward_backward(self, obs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, posterior of each state, expected transition counts of one sequence (M6)."""
        return self.smoothed(obs, np.ones(len(obs), int))

    def smoothed(self, obs: np.ndarray, active: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, posteriors and expected transition counts of sequences side by side.

        ``obs`` has the first steps of all sequences, longest first, then their second steps, and so on; ``active`` says how
        many sequences have each step.  A step of all sequences is one product of matrices.
        """
        dens = self.log_density(obs)
        top = dens.max(axis=1, keepdims=True)
        like = np.exp(dens - top)
        ahead, scale, back = np.empty_like(like), np.empty(len(like)), np.ones_like(like)
        at = np.concatenate([[0], np.cumsum(active)])
        for t in range(len(active)):
            here = slice(at[t], at[t + 1])
            a = like[here] * (self.start if t == 0 else ahead[at[t - 1] : at[t - 1] + active[t]] @ self.step)
            scale[here] = np.maximum(a.sum(axis=1), TINY)
            ahead[here] = a / scale[here, None]
        counts = np.zeros_like(self.step)
        for t in range(len(active) - 2, -1, -1):
            n = active[t + 1]
            after = like[at[t + 1] : at[t + 2]] * back[at[t + 1] : at[t + 2]] / scale[at[t + 1] : at[t + 2], None]
            back[at[t] : at[t] + n] = after @ self.step.T
            counts += self.step * (ahead[at[t] : at[t] + n].T @ after)
        posterior = ahead * back
        return float((np.log(scale) + top[:, 0]).sum()), posterior / posterior.sum(axis=1, keepdims=True), counts

    def viterbi(self, obs: np.ndarray) -> np.ndarray:
        """Most likely states of one sequence (M5)."""
        return self.paths(obs, np.ones(len(obs), int))

    def paths(self, obs: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Most likely states of sequences side by side, which are given as to ``smoothed``."""
        score, step = self.log_density(obs), np.log(self.step + TINY)
        came, path, at = np.zeros(score.shape, np.int32), np.empty(len(score), np.int32), np.concatenate([[0], np.cumsum(active)])
        score[: active[0]] += np.log(self.start + TINY)
        for t in range(1, len(active)):
            here = slice(at[t], at[t + 1])
            ways = score[at[t - 1] : at[t - 1] + active[t], :, None] + step
            came[here] = ways.argmax(axis=1)
            score[here] += ways.max(axis=1)
        for t in range(len(active) - 1, -1, -1):
            n = active[t + 1] if t + 1 < len(active) else 0  # the others end here
            path[at[t] + n : at[t + 1]] = score[at[t] + n : at[t + 1]].argmax(axis=1)
            path[at[t] : at[t] + n] = came[np.arange(at[t + 1], at[t + 1] + n), path[at[t + 1] : at[t + 1] + n]]
        return path

    def decode(self, rows: DataFrame, sequence: list[str], order: str, x: str = "x") -> DataFrame:
        """``sequence, order, state, posterior`` of all rows; many sequences (trials) are worked on side by side."""
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*sequence, order).schema) + ", state int, posterior array<double>"

        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                obs, lengths = _laid_out(batch.column("x"))
                state, posterior = np.empty(len(obs), np.int32), np.empty((len(obs), len(self.mean)))
                for at, active in _arranged(lengths, obs.shape[1]):
                    state[at], posterior[at] = self.paths(obs[at], active), self.smoothed(obs[at], active)[1]
                each = pa.array(np.repeat(np.arange(batch.num_rows), lengths))
                ends = pa.array(np.arange(len(obs) + 1, dtype=np.int32) * posterior.shape[1])
                columns = [*[batch.column(c).take(each) for c in sequence], batch.column("o").flatten(), pa.array(state), pa.ListArray.from_arrays(ends, pa.array(posterior.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, [*sequence, order, "state", "posterior"])

        return _grouped(rows, sequence, order, F.col(x)).select(*sequence, F.col("w.o").alias("o"), F.col("w.x").alias("x")).mapInArrow(decoded, kinds)


#: Values of observations that are worked on side by side.
SIDE_BY_SIDE = 1 << 19
#: Values for which a task of a fit is worth starting.
WORTH = 1 << 16


def _grouped(rows: DataFrame, sequence: list[str], order: str, x: Column) -> DataFrame:
    """``sequence, w``: the rows of each sequence in their order."""
    return rows.select(*sequence, F.col(order).alias("o"), x.alias("x")).groupBy(*sequence).agg(F.array_sort(F.collect_list(F.struct("o", "x"))).alias("w"))


def _laid_out(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all sequences of a column of lists of arrays, and how many each has."""
    rows = column.flatten()
    return rows.flatten().to_numpy().reshape(len(rows), -1), pc.list_value_length(column).to_numpy()


def _arranged(lengths: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of sequences that stand one after another, as ``Hmm.smoothed`` takes them, the longest first, in groups of bounded size or one longer sequence."""
    starts, order = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
    before = (np.cumsum(lengths[order]) - lengths[order]) * width
    for group in np.split(order, np.flatnonzero(np.diff(before // SIDE_BY_SIDE)) + 1):
        n = lengths[group]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield (np.repeat(starts[group], n) + step)[np.argsort(step, kind="stable")], np.searchsorted(-n, -np.arange(n[0]))


def _side_by_side(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences as ``Hmm.smoothed`` takes them."""
    rows = np.concatenate(sequences)
    for at, active in _arranged(np.array(list(map(len, sequences))), rows.shape[1]):
        yield rows[at], active


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of sequences side by side as bytes, so that no step of a fit takes lists of lists apart again."""
    for batch in batches:
        if batch.num_rows:
            rows, lengths = _laid_out(batch.column("obs"))
            for at, active in _arranged(lengths, rows.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array([rows[at].tobytes()]), pa.array([active.astype(np.int64).tobytes()])], ["obs", "active"])


def _expectation(fits: list[Hmm]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = fits[0].mean.shape[1]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each model: log-likelihood, start, transition counts, weights, sums and sums of squares of a partition's sequences, in one row of all."""
        total = None
        for batch in batches:
            for packed, sizes in zip(batch.column("obs"), batch.column("active"), strict=True):
                obs, active = np.frombuffer(packed.as_buffer()).reshape(-1, width), np.frombuffer(sizes.as_buffer(), np.int64)
                parts = []
                for model in fits:
                    ll, post, counts = model.smoothed(obs, active)
                    parts += [[ll], post[: active[0]].sum(axis=0), counts.ravel(), post.sum(axis=0), (post.T @ obs).ravel()]
                    if model.covariance == "diag":
                        parts.append((post.T @ obs**2).ravel())
                    elif model.covariance == "full":
                        parts.append(np.concatenate([((obs * w[:, None]).T @ obs).ravel() for w in post.T]))
                parts = np.concatenate(parts)
                total = parts if total is None else total + parts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["v"])

    return expect


def _improved(model: Hmm, v: np.ndarray, moments: np.ndarray, n: int, floor: float) -> tuple[Hmm, np.ndarray]:
    """The model of expected counts that stand first in ``v``, and the rest of ``v``."""
    k, d = model.mean.shape
    sizes = [1, k, k * k, k, k * d, {"diag": k * d, "full": k * d * d, "tied": 0}[model.covariance]]
    ll, start, counts, weight, first, second, rest = np.split(v, np.cumsum(sizes))
    weight = np.maximum(weight, TINY)[:, None]
    mu = first.reshape(k, d) / weight
    counts = counts.reshape(k, k)
    gone = counts.sum(axis=1, keepdims=True)
    step = np.where(gone > 0, counts / np.maximum(gone, TINY), 1 / k)
    if model.covariance == "diag":
        var = np.maximum(second.reshape(k, d) / weight - mu**2, floor)
    elif model.covariance == "full":
        var = np.stack([_floored(m / w - np.outer(c, c), floor) for m, w, c in zip(second.reshape(k, d, d), weight[:, 0], mu, strict=True)])
    else:
        var = _floored((moments - (mu.T * weight[:, 0]) @ mu) / n, floor)
    return Hmm(start / start.sum(), step, mu, var, (*model.history, float(ll[0])), covariance=model.covariance), rest


def starting(means: np.ndarray, cov: np.ndarray, covariance: str = "diag", floor: float = 1e-3) -> Hmm:
    """A model with given means, even probabilities and the covariance of all rows."""
    if covariance not in ("diag", "full", "tied"):
        raise ValueError(f"unknown covariance {covariance}")
    k = len(means)
    var = {"diag": lambda: np.tile(np.maximum(np.diag(cov), floor), (k, 1)), "full": lambda: np.tile(_floored(cov, floor), (k, 1, 1)), "tied": lambda: _floored(cov, floor)}[covariance]()
    return Hmm(np.full(k, 1 / k), np.full((k, k), 1 / k), np.array(means, float), var, covariance=covariance)


def along_axis(mean: np.ndarray, cov: np.ndarray, k: int) -> np.ndarray:
    """``k`` means evenly spread along the first principal axis."""
    values, vectors = np.linalg.eigh(cov)
    axis = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    spread = np.sqrt(max(values[-1], 0)) * (2 * (np.arange(k) + 0.5) / k - 1) * 1.5
    return mean + spread[:, None] * axis


def fit_many(rows: DataFrame, sequence: list[str], order: str, starts: list[Hmm], n_iter: int = 500, tol: float = 1e-3, x: str = "x", floor: float = 1e-3, known: tuple | None = None) -> list[Hmm]:
    """Expectation maximisation from many starts at once, each as a fit of its own would go.

    Starts may differ in states and covariances; eigenvalues of covariances are ``floor`` at least.  Sequences are
    grouped, packed and checkpointed once, less the mean of all rows, in at most as many partitions as there are cores; a step is one
    job of one stage that serves all models that have not converged, so jobs depend on the slowest fit alone.  The driver
    gets a row of sums a partition.  A fit has converged when its log-likelihood gains less than ``tol``.  ``known`` is what
    ``co_moments`` says of the rows, if that has been asked before.
    """
    n, centre, moments = known or co_moments(rows, x)
    if not n:
        raise ValueError("nothing to fit")
    less = F.array(*[F.col(x)[d] - float(c) for d, c in enumerate(centre)])
    grouped = _grouped(rows, sequence, order, less).select(F.col("w.x").alias("obs")).mapInArrow(_packed, "obs binary, active binary")
    sequences = checkpoint(grouped.repartition(min(rows.sparkSession.sparkContext.defaultParallelism, 1 + n * len(centre) // WORTH)))
    fits = [replace(m, mean=m.mean - centre, history=(), converged=False) for m in starts]
    going = list(range(len(fits)))
    for _ in range(n_iter):
        sums = sequences.mapInArrow(_expectation([fits[r] for r in going]), "v binary").collect()
        rest, still = np.sum([np.frombuffer(r["v"]) for r in sums], axis=0), []
        for r in going:
            fits[r], rest = _improved(fits[r], rest, moments, n, floor)
            h = fits[r].history
            if len(h) > 1 and h[-1] - h[-2] < tol:
                fits[r].converged = True
            else:
                still.append(r)
        going = still
        if not going:
            break
    return [replace(m, mean=m.mean + centre) for m in fits]


def fit_hmm(
    rows: DataFrame, sequence: list[str], order: str, k: int, n_iter: int = 500, tol: float = 1e-3, x: str = "x", floor: float = 1e-3, covariance: str = "diag",
    start: str = "axis", restarts: int = 1, seed: int = 42,
) -> Hmm:
    """A model of ``k`` states with ``diag``, ``full`` or ``tied`` covariances (M4, M7); it keeps its history.

    States start evenly spread along the first principal axis, or at the cluster centres of ``restarts`` seeds
    (``start="clusters"``), of which the fit of the greatest likelihood is returned.
    """
    from mesostate.operators.clustering import k_means

    n, mean, moments = co_moments(rows, x)
    if not n:
        raise ValueError("nothing to fit")
    if start not in ("axis", "clusters"):
        raise ValueError(f"unknown start {start}")
    means = [along_axis(mean, moments / n, k)] if start == "axis" else [c.points for c in k_means(rows, k, [seed + r for r in range(restarts)], x, known=(n, mean, moments))]
    fits = fit_many(rows, sequence, order, [starting(m, moments / n, covariance, floor) for m in means], n_iter, tol, x, floor, (n, mean, moments))
    return max(fits, key=lambda m: m.history[-1])


def restarted(rows: DataFrame, sequence: list[str], order: str, k: int, seeds: list[int], covariance: str = "diag", x: str = "x", n_iter: int = 500) -> tuple[DataFrame, list[Hmm]]:
    """Fits from the cluster centres of each seed, and ``seed, log_likelihood, n_iter, converged, gap, best`` of them; ``gap`` is to the best (M4)."""
    from mesostate.operators.clustering import k_means

    n, mean, moments = co_moments(rows, x)
    fits = fit_many(rows, sequence, order, [starting(c.points, moments / n, covariance) for c in k_means(rows, k, seeds, x, known=(n, mean, moments))], x=x, n_iter=n_iter, known=(n, mean, moments))
    ends = [m.history[-1] for m in fits]
    table = [(int(s), float(e), len(m.history), m.converged, float(max(ends) - e), e == max(ends)) for s, e, m in zip(seeds, ends, fits, strict=True)]
    return rows.sparkSession.createDataFrame(table, "seed int, log_likelihood double, n_iter int, converged boolean, gap double, best boolean"), fits


def _floored(matrix: np.ndarray, floor: float) -> np.ndarray:
    """A symmetric matrix with no eigenvalue under ``floor``."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def free_parameters(k: int, d: int, covariance: str = "diag") -> int:
    spread = {"diag": k * d, "full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2}[covariance]
    return k * (k - 1) + k * d + spread + k - 1


def bic(log_likelihood: float, k: int, d: int, n: int, covariance: str = "diag") -> float:
    """Bayesian information criterion with the free parameters of the covariance kind."""
    return -2 * log_likelihood + free_parameters(k, d, covariance) * float(np.log(n))


def bic_table(fits: DataFrame) -> DataFrame:
    """``fits`` (``k, d, n, covariance, log_likelihood``) with free parameters and criterion, the least first."""
    k, d = F.col("k"), F.col("d")
    spread = F.when(F.col("covariance") == "diag", k * d).when(F.col("covariance") == "full", k * d * (d + 1) / 2).otherwise(d * (d + 1) / 2)
    found = fits.withColumn("n_parameters", (k * (k - 1) + k * d + spread + k - 1).cast("long"))
    return found.withColumn("bic", -2 * F.col("log_likelihood") + F.col("n_parameters") * F.log("n")).orderBy("bic")


def check_lengths(rows: DataFrame, lengths: DataFrame, session: str, length: str = "n") -> DataFrame:
    """Sessions whose number of rows is not the stated length, of either table alone too; none if all is well (M8)."""
    counted = rows.groupBy(session).agg(F.count(F.lit(1)).alias("found"))
    both = counted.join(lengths.select(session, F.col(length).cast("long").alias("stated")), session, "full_outer")
    return both.where(~F.col("found").eqNullSafe(F.col("stated")))


def split(subjects: DataFrame, subject: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Each distinct subject with ``test`` true for about ``share`` of them, by a hash alone."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), subject)), 1, 8), 16, 10).cast("double") / 2**32
    return subjects.select(subject).distinct().withColumn("test", place < share)
