"""Texts as bytes: Arrow columns seen as one array of UTF-8 bytes with offsets, in slices of bounded size, and hashes of all words at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batch in order, each with the bytes of its texts and their offsets (one more than rows). Null counts as empty."""
    if not batch.num_rows:
        return
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] and text.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        part = offsets[first : last + 1]
        yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half of the output's."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, kept between calls."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, SLICE + 1)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            steps = np.full(n, _ODD, np.uint64)
            steps[0] = 1
            back = np.full(n, inverse, np.uint64)
            back[0] = 1
            _POWERS, _INVERSE = np.cumprod(steps), np.cumprod(back)
    return _POWERS, _INVERSE


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the row it is in. apart: the bytes between words. A word never reaches over a row's end."""
    inside = ~apart[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[:-1] = inside
    starts[1:-1] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cuts] = inside[cuts]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    ends[cuts] |= inside[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, from running sums of a polynomial modulo 2^64."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each row and the row of each; a row with fewer words, but some, gives its whole sequence as one. Not yet distinct."""
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    long = count >= n
    number = np.where(long, count - n + 1, 0)
    owner = np.repeat(np.arange(rows), number)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + first[owner]
    value = np.full(len(at), n * 0xA0761D6478BD642F % 2**64, np.uint64)
    for i in range(n):
        value = mix(value ^ words[at + i]) if len(at) else value
    short = np.flatnonzero((count > 0) & ~long)
    if len(short):
        rest = count[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        for i in range(n - 1):
            more = i < count[short]
            rest = np.where(more, mix(rest ^ words[np.minimum(first[short] + i, len(words) - 1)]), rest)
        owner, value = np.concatenate([owner, short]), np.concatenate([value, rest])
    return value, owner


def distinct(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each owner, sorted by owner and value."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]
