"""Arrays of arrays as one flat array with lengths."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each piece starts in the flat array."""
    return np.cumsum(lengths) - lengths


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start + length]``, one after another."""
    total = int(lengths.sum())
    index = np.arange(total) + np.repeat(starts - starts_of(lengths), lengths)
    return flat[index]


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each piece; 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs stay equal, all others scatter."""
    x = values + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def portions(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items of at most ``most`` in all, or of one larger item."""
    begin, total, at = 0, 0, -1
    for at, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(begin, at)
            begin, total = at, 0
        total += size
    if at >= begin:
        yield slice(begin, at + 1)
