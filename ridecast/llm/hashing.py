"""64-bit hashes of words and of runs of words, for whole columns of texts at once.

A word's hash is a polynomial over its bytes modulo 2**64 with a random value for each byte,
computed for all words from one cumulative sum, and mixed. Random odd multipliers of the
positions make a run's hash from its words'.
"""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**64, 256, np.uint64) | np.uint64(1)
_BASE = int(_random.integers(0, 2**61)) * 8 + 3
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _random.integers(1, 2**64, 64, np.uint64) | np.uint64(1)

#: White space as \x20 and \x09-\x0D; A-Z in lower case.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Anything but letters separates: a-z and the bytes of letters beyond ASCII remain.
NO_LETTER = np.ones(256, bool)
NO_LETTER[97:123] = False
NO_LETTER[128:] = False

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    known = _powers[which]
    if len(known) < n:
        size = 1 << (n - 1).bit_length()
        factor = np.full(size, _BASE if which == "up" else _BASE_INVERSE, np.uint64)
        factor[0] = 1
        known = _powers[which] = np.cumprod(factor, dtype=np.uint64)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, lower: bool = True):
    """A function from (first, end) places of `data` to the hashes of the bytes between them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    values = _BYTE[LOWER[data] if lower else data] * _power("up", len(data))
    np.cumsum(values, dtype=np.uint64, out=sums[1:])

    def of(first: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (sums[end] - sums[first]) * _power("down", len(data))[first]
        return mix(raw + (end - first).astype(np.uint64))

    return of


def word_places(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
    """(text number, first byte, byte after the last) of every word of texts laid end to end.

    `offsets` has a text's start and end; a word never spans two texts.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separators[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    ends[before] = inside[before]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return np.searchsorted(offsets, first, "right") - 1, first, last


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, lower: bool = True):
    """All words of texts laid end to end: (hash, text number, first byte, byte after the last)."""
    text, first, last = word_places(data, offsets, separators)
    if not len(first):
        return np.zeros(0, np.uint64), text, first, last
    return spans(data, lower)(first, last), text, first, last


def runs(hashes: np.ndarray, text: np.ndarray, n_texts: int, size: int, short: bool = True):
    """Hashes of every run of `size` words, with its text and the number of its first word.

    With `short`, a text of fewer words gives its whole sequence as one run.
    """
    counts = np.bincount(text, minlength=n_texts)
    n = len(hashes) - size + 1
    if n > 0:
        run = np.zeros(n, np.uint64)
        for k in range(size):
            run += hashes[k : k + n] * _PLACE[k]
        whole = np.flatnonzero(text[:n] == text[size - 1 :])
        run, of = mix(run[whole] + np.uint64(size)), text[whole]
    else:
        run, of, whole = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if short and (few := np.flatnonzero((counts > 0) & (counts < size))).size:
        begin = np.searchsorted(text, few)
        extra = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            has = counts[few] > k
            extra[has] += hashes[begin[has] + k] * _PLACE[k]
        run = np.concatenate([run, mix(extra + counts[few].astype(np.uint64))])
        of, whole = np.concatenate([of, few]), np.concatenate([whole, begin])
        order = np.argsort(whole, kind="stable")
        run, of, whole = run[order], of[order], whole[order]
    return run, of, whole
