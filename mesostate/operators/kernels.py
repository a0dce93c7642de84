"""Filters, envelopes, resampling and spectra of ``array<double>`` signals, in Arrow batches.

Each kernel is a function of a column; rows of equal length in a batch are one NumPy matrix, so many at a time that
a batch and ``AT_ONCE`` values bound the memory.  Null signals stay null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Values of signals of one length that a kernel works on at once.
AT_ONCE = 1 << 16


def _by_length(column: pd.Series, work: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """``work`` on matrices of signals of one length, of ``AT_ONCE`` values or one longer signal; its result has a row a signal.

    Results of a matrix are copied, as rows that are part of a wider array would keep all of it.
    """
    out = pd.Series([None] * len(column), dtype=object)
    lengths = np.array([-1 if v is None else len(v) for v in column])
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        for few in np.split(at, range(step := max(AT_ONCE // max(int(n), 1), 1), len(at), step)):
            found = work(np.stack([np.asarray(column.iloc[k], float) for k in few]))
            for k, row in zip(few, found.copy() if isinstance(found, np.ndarray) else found, strict=True):
                out.iat[k] = row
    return out


def band_pass(fs: float, lo: float, hi: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a digital Butterworth band-pass, by the bilinear transform."""
    w = np.tan(np.pi * np.array([lo, hi]) / fs)
    low_pass = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * (w[1] - w[0]) / 2
    root = np.sqrt(low_pass**2 - w[0] * w[1])
    poles = np.concatenate([low_pass + root, low_pass - root])
    gain = (w[1] - w[0]) ** order / np.prod(1 - poles).real
    return gain * np.poly(np.repeat([1.0, -1.0], order)), np.poly((1 + poles) / (1 - poles)).real


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter along rows, from the steady state of each row's first value."""
    turn = np.eye(len(a) - 1, k=1)
    turn[:, 0] -= a[1:]
    feed = b[1:] - a[1:] * b[0]
    state = np.outer(x[:, 0], np.linalg.solve(np.eye(len(feed)) - turn, feed))
    y = np.empty_like(x)
    for t in range(x.shape[1]):
        y[:, t] = state[:, 0] + b[0] * x[:, t]
        state = state @ turn.T + np.outer(x[:, t], feed)
    return y


def _odd(x: np.ndarray, n: int) -> np.ndarray:
    """Rows continued at both ends by ``n`` values, turned about their end points."""
    return np.hstack([2 * x[:, :1] - x[:, n:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -n - 2 : -1]])


def ringing(b: np.ndarray, a: np.ndarray, most: int = 100_000) -> int:
    """Samples until the response to one impulse stays under a thousandth of its greatest value, looked at a thousand at a time."""
    x, turn = np.zeros((1, 1000)), np.eye(len(a) - 1, k=1)
    turn[:, 0] -= a[1:]
    feed, state, x[0, 0] = b[1:] - a[1:] * b[0], np.zeros(len(a) - 1), 1.0
    least, last = 0.0, 1000
    for start in range(0, most, 1000):
        y = np.empty(1000)
        for t, v in enumerate(x[0]):
            y[t] = state[0] + b[0] * v
            state = state @ turn.T + v * feed
        x[0, 0] = 0.0
        least = max(least, 0.001 * np.abs(y).max())
        loud = np.flatnonzero(np.abs(y) > least)
        if not len(loud):
            return start - 1000 + last
        last = int(loud[-1])
    return most


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """The filter forwards and backwards, so without a phase shift.

    Signals are continued by ``pad`` values or as far as they reach; by default by three values a coefficient, and shorter ones
    raise an error.
    """
    if pad is None:
        pad = 3 * len(a)
        if x.shape[1] <= pad:
            raise ValueError(f"signals of {x.shape[1]} samples are too short, over {pad} are needed")
    pad = min(pad, x.shape[1] - 1)
    if pad < 1:
        return _run(b, a, _run(b, a, x)[:, ::-1])[:, ::-1]
    y = _run(b, a, _odd(x, pad))
    return _run(b, a, y[:, ::-1])[:, ::-1][:, pad:-pad]


def magnitude(x: np.ndarray) -> np.ndarray:
    """Absolute value of the analytic signal of each row."""
    n = x.shape[1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * weight, axis=1))


def envelope(samples: Column | str, fs: float, lo: float, hi: float, log: str = "log1p") -> Column:
    """Mean envelope of a band: ``log1p(p)`` (F4, F5) or, with ``log='floor'``, ``ln(p + 1e-12)`` of a filter whose ends reach as far as it rings."""
    b, a = band_pass(fs, lo, hi)
    pad = None if log == "log1p" else ringing(b, a)

    def work(x: np.ndarray) -> np.ndarray:
        power = magnitude(both_ways(b, a, x, pad)).mean(axis=1)
        return np.log1p(power) if log == "log1p" else np.log(power + 1e-12)

    @F.pandas_udf("double")
    def kernel(column: pd.Series) -> pd.Series:
        return _by_length(column, work).astype(float)

    return kernel(samples)


def low_pass_taps(fs: float, cut: float) -> np.ndarray:
    """Odd number of Hamming-windowed sinc taps; the transition band is a quarter of ``cut``, 2 Hz at least."""
    width = min(max(0.25 * cut, 2.0), fs / 2 - cut)
    n = int(np.ceil(3.3 / width * fs)) | 1
    t = np.arange(n) - n // 2
    taps = np.sinc(2 * (cut + width / 2) / fs * t) * np.hamming(n)
    return taps / taps.sum()


def low_pass(samples: Column | str, fs: float, cut: float) -> Column:
    """Zero-phase FIR low-pass; ends are continued oddly as far as the signal reaches, then by zeros (PRE2)."""
    taps = low_pass_taps(fs, cut)
    half = len(taps) // 2

    def work(x: np.ndarray) -> np.ndarray:
        reach = min(half, x.shape[1] - 1)
        longer = np.pad(_odd(x, reach) if reach else x, ((0, 0), (half - reach, half - reach)))
        size = 1 << int(np.ceil(np.log2(longer.shape[1] + len(taps))))
        y = np.fft.irfft(np.fft.rfft(longer, size, axis=1) * np.fft.rfft(taps, size), size, axis=1)
        return y[:, 2 * half : 2 * half + x.shape[1]]

    @F.pandas_udf("array<double>")
    def kernel(column: pd.Series) -> pd.Series:
        return _by_length(column, lambda x: work(x) if x.shape[1] else x)

    return kernel(samples)


def resample(samples: Column | str, old: float, new: float) -> Column:
    """Signals at another rate, by their Fourier series; equal rates change nothing (PRE3)."""

    def work(x: np.ndarray) -> np.ndarray:
        n, m = x.shape[1], round(x.shape[1] * new / old)
        if n == m or not n:
            return x
        spectrum, least = np.fft.rfft(x, axis=1)[:, : min(n, m) // 2 + 1], min(n, m)
        if least % 2 == 0:
            spectrum[:, -1] *= 2 if m < n else 0.5
        return np.fft.irfft(spectrum, m, axis=1) * m / n

    @F.pandas_udf("array<double>")
    def kernel(column: pd.Series) -> pd.Series:
        return _by_length(column, work)

    return kernel(samples)


def welch(samples: Column | str, fs: float, lo: float = 1.0, hi: float = 45.0, segment: int = 256) -> Column:
    """``array<struct<f, p>>``: one-sided power density within ``lo..hi``, Hann segments overlapping by half (QC3)."""

    def work(x: np.ndarray) -> list:
        size = min(segment, x.shape[1])
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, :: size - size // 2]
        parts = (parts - parts.mean(axis=2, keepdims=True)) * window
        p = (np.abs(np.fft.rfft(parts, axis=2)) ** 2).mean(axis=1) / (fs * (window**2).sum())
        p[:, 1 : -1 if size % 2 == 0 else None] *= 2
        f = np.fft.rfftfreq(size, 1 / fs)
        kept = (f >= lo) & (f <= hi)
        return [[{"f": g, "p": v} for g, v in zip(f[kept], row[kept], strict=True)] for row in p]

    @F.pandas_udf("array<struct<f: double, p: double>>")
    def kernel(column: pd.Series) -> pd.Series:
        return _by_length(column, lambda x: work(x) if x.shape[1] > 1 else [[] for _ in x])

    return kernel(samples)
