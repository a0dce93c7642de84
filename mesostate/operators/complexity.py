"""Sample entropy: how rarely stretches of a signal that are alike go on alike."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Candidate pairs that are compared at once.
PAIRS = 1 << 20


def alike(x: np.ndarray, m: int, r: float) -> tuple[int, int]:
    """Pairs of stretches of ``m`` values no two of which differ by more than ``r``, and how many go on so for one more value.

    Stretches are put in boxes of side ``r``, and only those of the same or a neighbouring box are compared.  Stretches that have
    a next value count.
    """
    n = len(x) - m
    if n < 2:
        return 0, 0
    if r <= 0:
        kinds = np.stack([x[k : k + n] for k in range(m + 1)], axis=1)
        same = [np.unique(kinds[:, : m + k], axis=0, return_counts=True)[1] for k in (0, 1)]
        return tuple(int((c * (c - 1) // 2).sum()) for c in same)
    stretches = np.stack([x[k : k + n] for k in range(m + 1)], axis=1)
    boxes = np.floor((stretches[:, :m] - x.min()) / (r * (1 + 1e-6)))  # wider by more than rounding
    boxes = np.minimum(boxes, 2.0**40).astype(np.int64)
    names, box = np.unique(boxes, axis=0, return_inverse=True)
    box = box.ravel()
    order = np.argsort(box, kind="stable")
    edges = np.searchsorted(box[order], np.arange(len(names) + 1))
    known = {tuple(b): k for k, b in enumerate(names.tolist())}
    found = longer = 0
    for step in product((-1, 0, 1), repeat=m):
        if step < (0,) * m:
            continue  # each pair of boxes once
        to = np.array([known.get(tuple(b), -1) for b in (names + np.array(step)).tolist()])
        other = to[box]  # the neighbouring box of each stretch
        has = np.flatnonzero(other >= 0)
        counts = edges[other[has] + 1] - edges[other[has]]
        ends = np.cumsum(counts)
        at = 0
        while at < len(has):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            c = counts[at:upto]
            a = np.repeat(has[at:upto], c)
            b = order[np.repeat(edges[other[has[at:upto]]] - (np.cumsum(c) - c), c) + np.arange(len(a))]
            if not any(step):
                a, b = a[a < b], b[a < b]
            near = (np.abs(stretches[a, :m] - stretches[b, :m]) <= r).all(axis=1)
            found += int(near.sum())
            longer += int((np.abs(stretches[a[near], m] - stretches[b[near], m]) <= r).sum())
            at = upto
    return found, longer


def sample_entropy(samples: Column, m: int = 2, r: float = 0.2) -> Column:
    """``-log(A / B)`` of the pairs of stretches of ``m`` samples within ``r`` deviations (B) and those of them that go on so (A).

    Null where no pair is alike or none goes on alike, as in short or wholly irregular signals; 0 for a constant one.
    """

    @F.pandas_udf("double")
    def entropy(signals: pd.Series) -> pd.Series:
        out = []
        for signal in signals:
            x = np.zeros(0) if signal is None else np.asarray(signal, float)
            found, longer = alike(x, m, r * float(x.std())) if len(x) else (0, 0)
            out.append(-math.log(longer / found) + 0.0 if longer else None)
        return pd.Series(out, dtype="float64")

    return entropy(samples)
