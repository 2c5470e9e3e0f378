"""Array kernels of the depth-limited suffix sort; see ``suffix_dedup``."""

from __future__ import annotations

import numpy as np

from .common import prefix_hash, range_hash

#: Depth in bytes through which suffixes are ordered: the length of a repeated string.
DEPTH = 100
#: Bytes of the grams whose least hash in a window is the window's first digit.
GRAM = 32
SPAN = DEPTH - GRAM + 1

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, width: int, fold: np.ufunc, pad: int | np.uint64) -> np.ndarray:
    """fold over x[i : i + width] for each i that has a full window (van Herk's two block scans)."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    y = np.full(blocks * width, pad, x.dtype)
    y[: len(x)] = x
    y = y.reshape(blocks, width)
    left = fold.accumulate(y, 1).ravel()
    right = fold.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return fold(right[:n], left[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with the same first digit, over all texts of a chunk.

    Returns per run: text number, first window's start in the text, number of
    windows, first digit, two hashes of the run's bytes, and whether windows
    inside the run may be equal.
    """
    prefix = prefix_hash(data)
    n = len(data)
    none = np.zeros(0, np.int64)
    nothing = none, none, none, *[none.astype(np.uint64)] * 3, none.astype(bool)
    if n < DEPTH:
        return nothing
    at = np.arange(n - GRAM + 1)
    gram = range_hash(prefix, at, at + GRAM)
    least = sliding(gram, SPAN, np.minimum, _TOP)
    # Windows that would reach into the next text do not exist.
    size = np.diff(offsets)
    windows = np.maximum(size - DEPTH + 1, 0)
    text = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[text]
    if not len(start):
        return nothing
    value = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    lo, owner, digit = start[first], text[first], value[first]
    whole, whole2 = (range_hash(p, lo, lo + count + DEPTH - 1) for p in (prefix, prefix_hash(data, True)))
    # Two equal windows of one run hold the least gram at two places, and no
    # other window's least gram lies between these.
    most = sliding(np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)]), SPAN, np.maximum, np.uint64(0))
    anchors = np.flatnonzero(gram == most)
    twice = np.zeros(len(anchors) + 1, np.int64)
    if len(anchors) > 1:
        twice[1:-1] = np.cumsum((gram[anchors[1:]] == gram[anchors[:-1]]) & (np.diff(anchors) <= SPAN))
        twice[-1] = twice[-2]
    a, b = np.searchsorted(anchors, lo), np.searchsorted(anchors, lo + count + SPAN - 1)
    inner = (b - a >= 2) & (twice[np.maximum(b - 1, 0)] > twice[a])
    return owner, lo - offsets[owner], count, digit, whole, whole2, inner


def window_digits(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digits, 128 bits in all, through the whole depth of the windows at ``start``."""
    first, second = (range_hash(prefix_hash(data, k), start, start + DEPTH) for k in (False, True))
    return first, second


def radix_groups(raw: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depth-limited radix sort of the windows at ``start``, most significant digit first, inside the given groups.

    A digit is 8 bytes of the text itself (4 in the last pass). Each pass orders
    only windows that are still tied with another. Returns the windows tied
    through the whole depth, and their groups.
    """
    at = np.arange(len(start))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    for depth in range(-8, DEPTH, 8):
        # Before the first digit only the groups as given are told apart.
        digit = words[start[at] + depth].astype(np.uint64) if depth >= 0 else np.zeros(len(at), np.uint64)
        if depth > DEPTH - 8:
            digit >>= np.uint64(8 * (depth + 8 - DEPTH))
        order = np.lexsort((digit, group))
        at, digit, group = at[order], digit[order], group[order]
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        tied = ~(new[:-1] & new[1:])
        at, group = at[tied], np.cumsum(new[:-1])[tied]
    return at, group


def first_of(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by keys, then order. Returns the permutation and, in it, the marks of each key's first."""
    perm = np.lexsort((*reversed(order), *reversed(keys)))
    head = np.ones(len(perm), bool)
    if len(perm):
        head[1:] = np.any([k[perm][1:] != k[perm][:-1] for k in keys], axis=0)
    return perm, head


__all__ = ["DEPTH", "GRAM", "first_of", "radix_groups", "runs", "sliding", "window_digits"]
