"""Hashes of words and of runs of words, for whole texts in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5  # words of a shingle
AT_ONCE = 1024  # texts that a worker has in Python at a time
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * STEP
    return x ^ (x >> np.uint64(31))


def few_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most AT_ONCE."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def word_hasher() -> Callable[[bytes], np.ndarray]:
    """text (UTF-8) -> a 64-bit hash per word, A-Z taken as a-z. Words are what bytes.split() gives: runs of other bytes than
    the ASCII white space \\x20 and \\x09-\\x0D."""
    from xxhash import xxh3_64_intdigest

    def hashes(text: bytes) -> np.ndarray:
        words = text.lower().split()
        # a table of known words would take longer than the hash, and a worker's memory
        return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))

    return hashes


def runs(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of every run of `width` words, in text order; fewer words are one run, none give none."""
    if not len(words):
        return words
    n = max(len(words) - width + 1, 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for d in range(min(width, len(words))):
            out = out * STEP + words[d : d + n] + np.uint64(d + 1)
        return mixed(out)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted, each once. np.unique takes several times as long for the few hundred numbers of a text."""
    ordered = np.sort(numbers, axis=None)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def shingle_set(words: np.ndarray) -> np.ndarray:
    return distinct(runs(words))
