"""Probabilities of hidden states given all rows so far, on tables and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mesostate.operators.models import TINY, Hmm, _arranged, _grouped, _laid_out


#: Groups that sequences of a stream are dealt to; each keeps the state of its own in one value.
DEALT = 1024


def forward(model: Hmm, obs: np.ndarray, ahead: np.ndarray | None, anew: np.ndarray | None = None) -> np.ndarray:
    """Probability of each state after each row, from the vector that the rows before ended with (None: the start of a sequence).

    The sequence starts anew at rows that ``anew`` marks.
    """
    new = np.zeros(len(obs), bool) if anew is None else np.array(anew, bool)
    new[:1] |= ahead is None
    return forward_all(model, obs, np.array([len(obs)]), new, np.reshape(model.start if ahead is None else ahead, (1, -1)))


def forward_all(model: Hmm, obs: np.ndarray, lengths: np.ndarray, anew: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """``forward`` of sequences that stand one after another, worked on side by side; ``ahead`` has the vector that each goes on from."""
    out = np.empty((len(obs), len(model.start)))
    if not len(obs):
        return out
    starts = np.cumsum(lengths) - lengths
    for at, active in _arranged(lengths, obs.shape[1]):
        dens = model.log_density(obs[at])
        like, new = np.exp(dens - dens.max(axis=1, keepdims=True)), anew[at]
        ends, before = np.concatenate([[0], np.cumsum(active)]), ahead[np.searchsorted(starts, at[: active[0]])]
        for t, n in enumerate(active.tolist()):
            here = slice(ends[t], ends[t + 1])
            a = like[here] * np.where(new[here, None], model.start, before[:n] @ model.step)
            before = like[here] = a / np.maximum(a.sum(axis=1, keepdims=True), TINY)
        out[at] = like
    return out


def _kinds(rows: DataFrame, *columns: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema) + ", p array<double>"


def filtered(rows: DataFrame, model: Hmm, sequence: str, order: str, x: str = "x") -> DataFrame:
    """``sequence, order, p``: probability of each state given the rows of the sequence up to this one."""

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                obs, lengths = _laid_out(batch.column("x"))
                anew = np.zeros(len(obs), bool)
                anew[np.cumsum(lengths) - lengths] = True
                p = forward_all(model, obs, lengths, anew, np.tile(model.start, (len(lengths), 1)))
                each = pa.array(np.repeat(np.arange(batch.num_rows), lengths))
                ends = pa.array(np.arange(len(obs) + 1, dtype=np.int32) * p.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(sequence).take(each), batch.column("o").flatten(), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], [sequence, order, "p"])

    return _grouped(rows, [sequence], order, F.col(x)).select(sequence, F.col("w.o").alias("o"), F.col("w.x").alias("x")).mapInArrow(given, _kinds(rows, sequence, order))


class _Forward(StatefulProcessor):
    """Keeps the forward vectors and last times of the sequences of a group; a timer forgets each after ``idle`` of event time without rows."""

    def __init__(self, model: Hmm, key: str, ts: str, x: str, idle_ms: int):
        self.model, self.key, self.ts, self.x, self.idle_ms = model, key, ts, x, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "names array<string>, ahead array<double>, last array<long>, timer long")

    def _load(self) -> tuple[dict[str, tuple[np.ndarray, int]], int | None]:
        """Vector and last time of each sequence, and when the timer is due."""
        if not self.kept.exists():
            return {}, None
        names, ahead, last, timer = self.kept.get()
        return dict(zip(names, zip(np.reshape(ahead, (len(names), -1)), last, strict=True), strict=True)), timer

    def _keep(self, known: dict[str, tuple[np.ndarray, int]], timer: int | None) -> None:
        """Stores ``known``; the timer is due when its first sequence is to be forgotten."""
        due = min(last for _, last in known.values()) // 1000 + self.idle_ms
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.kept.update((list(known), np.concatenate([a for a, _ in known.values()]).tolist(), [int(last) for _, last in known.values()], due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True)
        micros = given[self.ts].to_numpy().astype("datetime64[us]").astype(np.int64)
        codes, names = pd.factorize(given[self.key], use_na_sentinel=False)
        names = [str(n) for n in names.tolist()]
        known, timer = self._load()
        new = (self.model.start, np.iinfo(np.int64).min)
        ahead, last = (np.array(v) for v in zip(*[known.get(n, new) for n in names], strict=True))
        order = np.lexsort((micros, codes))
        order = order[micros[order] > last[codes[order]]]
        if not len(order):
            return
        micros, codes = micros[order], codes[order]
        at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        whose, begun = codes[at], last[codes[at]] == new[1]
        before = np.append(0, micros[:-1])
        before[at] = np.where(begun, micros[at], last[whose])
        anew = micros - before > self.idle_ms * 1000
        anew[at] |= begun
        p = forward_all(self.model, np.stack(given[self.x].to_numpy()[order]), np.diff(np.append(at, len(codes))), anew, ahead[whose])
        for c, end in zip(whose.tolist(), np.append(at[1:], len(codes)) - 1, strict=True):
            known[names[c]] = p[end], int(micros[end])
        self._keep(known, timer)
        yield given.loc[order, [self.key, self.ts]].assign(p=list(p))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, _ = self._load()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        known = {n: v for n, v in known.items() if v[1] // 1000 + self.idle_ms > now}
        if known:
            self._keep(known, None)  # the one that was due is gone
        else:
            self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def online_filter(rows: DataFrame, model: Hmm, sequence: str, ts: str, late: str, idle_ms: int, x: str = "x", dealt: int = DEALT) -> DataFrame:
    """``filtered`` of a stream: each row's probabilities once it comes, from one vector a sequence that is kept as state.

    Sequences, of a plain type, are dealt by a hash to ``dealt`` groups (null has one of its own).  A group is one call and one
    value of state a batch, and its sequences are worked on side by side, so calls do not grow with sequences.

    Rows of a batch are taken in order of time.  Rows older than the watermark (the greatest time seen less ``late``), or not
    later than the last row taken of their sequence, are left out.  A sequence starts anew after more than ``idle_ms`` of event
    time without rows; a timer then drops its state.  The session needs the RocksDB state store.
    """
    group = F.when(F.col(sequence).isNull(), -1).otherwise(F.pmod(F.xxhash64(sequence), F.lit(dealt))).cast("int")
    kept = rows.select(sequence, ts, x, group.alias("_group")).withWatermark(ts, late)
    processor = _Forward(model, sequence, ts, x, idle_ms)
    return kept.groupBy("_group").transformWithStateInPandas(processor, _kinds(rows, sequence, ts), "Append", "EventTime")
