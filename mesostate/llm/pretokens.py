"""Byte-level pre-tokens of whole batches, and encoders that do each distinct one once.

``split`` cuts texts as the usual pattern of byte-level vocabularies does:
contractions, then runs of letters, digits or other characters with one blank
before them, then white space.  Characters that this Python's Unicode tables do
not know yet are asked of the tokenizer's own library, one by one.

An encoder knows a pre-token by its bytes.  Within a batch, occurrences are
grouped by a hash, and each is compared byte by byte with the first of its group.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd

from mesostate.llm.textops import ragged, range_hashes

SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
#: Distinct pre-tokens, and bytes of them, that a worker keeps before it forgets those met least often.
KEPT, KEPT_BYTES = 250_000, 16 << 20
_CHUNK = 1 << 16


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        first = category[0]
        if category == "Cn":
            kinds[c] = UNKNOWN
        elif first == "L":
            kinds[c] = LETTER
        elif first == "N":
            kinds[c] = DIGIT
    # characters with the property White_Space (fixed by Unicode)
    kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


def split(data: np.ndarray, offsets: np.ndarray, probe: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens, and the index of each text's first one (one more at the end).

    ``probe`` tells LETTER, DIGIT or OTHER of a character that is not assigned here.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    kind = _classes()[code]
    for c in np.unique(code[kind == UNKNOWN]).tolist():
        kind[code == c] = probe(chr(c))
    n = len(code)
    opens = np.zeros(n + 1, bool)  # characters that open a text
    opens[np.searchsorted(at, offsets)] = True
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    after_space = np.flatnonzero(run & ~opens[:n] & (kind != SPACE))
    after_space = after_space[kind[after_space - 1] == SPACE]
    start[after_space - 1] = True
    start[after_space] = code[after_space - 1] != 0x20
    quote = np.flatnonzero((code[:-1] == 0x27) & start[:-1] & run[:-1] & (kind[1:] == LETTER) & ~opens[1:n])
    for q in quote.tolist():
        one = chr(code[q + 1])
        two = one + chr(code[q + 2]) if q + 2 < n and not opens[q + 2] else ""
        length = 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") else 0
        if length:
            start[q + 1] = False
            if q + length < n:
                start[q + length] = True
    starts = at[start]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


class WordEncoder:
    """Ids of pre-tokens; ``encode`` is called once for each distinct one that is new to this worker."""

    def __init__(self, encode: Callable[[list[bytes]], list[Sequence[int]]]):
        self.encode = encode
        self.known: dict[bytes, int] = {}
        self.size = 0  # bytes of what is known
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int32)  # runs that held the pre-token

    def forget(self) -> None:
        """Keeps at most half of what is known: what was met in most runs."""
        words = list(self.known)  # in order of their slots
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        least = 2
        while (self.met >= least).sum() > KEPT // 2 or lengths[self.met >= least].sum() > KEPT_BYTES // 2:
            least += 1
        keep = np.flatnonzero(self.met >= least)
        n = self.ends[keep + 1] - self.ends[keep]
        self.ids = self.ids[ragged(self.ends[keep], n)]
        self.ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        self.met = self.met[keep] // 2
        self.known = {words[k]: slot for slot, k in enumerate(keep.tolist())}
        self.size = int(lengths[keep].sum())

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, pre-token after pre-token, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        codes, first = distinct_ranges(data, starts, ends)
        if len(self.known) > KEPT or self.size > KEPT_BYTES:
            self.forget()
        whole = data.tobytes()
        words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        slot = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        if len(new := np.flatnonzero(slot < 0)):
            fresh = [words[k] for k in new.tolist()]
            found = [f for k in range(0, len(fresh), _CHUNK) for f in self.encode(fresh[k : k + _CHUNK])]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            slot[new] = np.arange(len(new)) + len(self.ends) - 1
            self.known.update(zip(fresh, slot[new].tolist(), strict=True))
            self.size += sum(map(len, fresh))
            self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.uint32, int(lengths.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        self.met[slot] += 1
        mine = slot[codes]
        counts = self.ends[mine + 1] - self.ends[mine]
        return self.ids[ragged(self.ends[mine], counts)], counts


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code of each byte range, equal for equal bytes alone, and the index of each code's first range; the ranges tile ``data``."""
    codes, distinct = pd.factorize(range_hashes(data, starts, ends))
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    lengths = ends - starts
    model = first[codes]
    other = np.repeat(starts[model] - starts, lengths)
    other += np.arange(len(data))
    differs = data != data[np.minimum(other, len(data) - 1, out=other)]
    wrong = lengths != lengths[model]
    if differs.any():
        wrong[np.searchsorted(np.cumsum(lengths), np.flatnonzero(differs), "right")] = True
    if wrong.any():  # ranges that share a hash with other bytes
        whole, more, seen = data.tobytes(), [], {}
        for k in np.flatnonzero(wrong).tolist():
            word = whole[starts[k] : ends[k]]
            if word not in seen:
                seen[word] = len(first) + len(more)
                more.append(k)
            codes[k] = seen[word]
        first = np.concatenate([first, np.array(more, np.int64)])
    return codes, first


def per_text(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where each text's ids start among all ids (one more at the end)."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])[first]
