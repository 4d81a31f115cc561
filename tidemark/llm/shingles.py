"""Sets of hashed word shingles, for whole slices of texts at once in numpy."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import mix
from tidemark.llm.words import pieces_of

_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes of text worked on at once: a worker holds several arrays of eight bytes for each of them.
SLICE_BYTES = 1 << 19


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(n, 64), _STEP)], dtype=np.uint64)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, A to Z lower-cased, and how many each text has."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    text = _FOLD[data]
    space = _SPACE[text]
    begin = ~space
    begin[1:] &= space[:-1]
    inner = at[1:-1][at[1:-1] < len(data)]
    begin[inner] = ~space[inner]  # a word begins anew with its text
    words = np.flatnonzero(begin)
    per = np.searchsorted(words, at[1:]) - np.searchsorted(words, at[:-1])
    if not len(words):
        return np.zeros(0, np.uint64), per
    text = text[~space]
    start = np.flatnonzero(begin[~space])
    size = np.diff(np.r_[start, len(text)])
    place = np.arange(len(text)) - np.repeat(start, size)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[text] * _powers(int(size.max()))[place], start)
        return mix(h + size.astype(np.uint64) * _STEP), per


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int):
    """For each text, the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence as one."""
    with np.errstate(over="ignore"):
        factors = mix(np.arange(1, k + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    slices, n = [], len(at) - 1
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1)
        slices.append((lo, min(hi, n)))
        lo = min(hi, n)
    for lo, hi in slices:
        part = data[at[lo] : at[hi]]
        if len(part) > 2 * SLICE_BYTES:  # one very long text
            found = [word_hashes(np.frombuffer(p, np.uint8), np.array([0, len(p)])) for p in pieces_of(part.tobytes(), SLICE_BYTES)]
            words, per = np.concatenate([w for w, _ in found]), np.array([sum(int(p[0]) for _, p in found)])
        else:
            words, per = word_hashes(part, at[lo : hi + 1] - at[lo])
        ends = np.cumsum(per)
        with np.errstate(over="ignore"):
            padded = np.r_[words, np.zeros(k, np.uint64)]
            joined = sum((padded[i : i + len(words)] * factors[i] for i in range(k)), np.zeros(len(words), np.uint64))
            joined = mix(joined)
            for e, m in zip(ends.tolist(), per.tolist()):
                s = e - m
                if m >= k:
                    yield np.unique(joined[s : e - k + 1])
                elif m:
                    yield mix((words[s:e] * factors[:m]).sum(keepdims=True) + np.uint64(m) * _STEP)
                else:
                    yield np.zeros(0, np.uint64)
