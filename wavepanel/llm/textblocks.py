"""Words and hashes of whole texts in numpy, a bounded block of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20  # bytes that are looked at together
_ODD = 0x9E3779B97F4A7C15

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte; A-Z have those of a-z.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]

_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        base = 0xD1342543DE82EF95
        for k, factor in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k:k + 1] = [np.multiply.accumulate(steps)]
    return _powers


def _hash_block(b: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~separators[b]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    power, inverse = _tables(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * power[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(_ODD)), starts


def hash_words(data: bytes, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of each word of ``data``, A-Z taken as a-z.

    Long data go through in blocks that end at a separator, so that memory
    follows the block and the words, not the bytes.
    """
    b = np.frombuffer(data, np.uint8)
    if len(b) <= BLOCK:
        return _hash_block(b, separators)
    hashes, starts, lo = [], [], 0
    while lo < len(b):
        hi = min(lo + BLOCK, len(b))
        if hi < len(b):
            last = np.flatnonzero(separators[b[lo:hi]])
            if len(last):
                hi = lo + int(last[-1]) + 1
            else:  # a word longer than a block
                rest = np.flatnonzero(separators[b[hi:]])
                hi = hi + int(rest[0]) + 1 if len(rest) else len(b)
        h, s = _hash_block(b[lo:hi], separators)
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(starts)


def grouped(texts: list[str | None], most: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8 of at most ``most`` bytes together, or one longer text; null counts as empty."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(data) + 1 > most:
            yield first, run
            first, run, size = i, [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run


def words_by_text(run: list[bytes], separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run of texts, and where each text's words begin (one more entry than texts)."""
    hashes, starts = hash_words(b"\n".join(run), separators)
    at = np.cumsum([0] + [len(x) + 1 for x in run])
    return hashes, np.searchsorted(starts, at)
