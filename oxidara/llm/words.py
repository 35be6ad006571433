"""Words and word n-grams of whole Arrow columns as 64-bit numbers, without a Python loop over words.

A column is worked on in runs of rows of about CHUNK_BYTES; a row is always whole in one run.  A word's
number is a polynomial over its bytes modulo 2**64 (prefix sums give it for every word at once), passed through a
mixing function, so it depends on the word alone and never on the run, the task or the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time inside a task.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C13
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


@dataclass
class Run:
    """Some whole rows of a column: their bytes one after another and where each row begins and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray  # row of the run
    value: np.ndarray  # the word's number

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.owner, minlength=rows)


def runs(column: pa.Array, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[Run]:
    """A string column in runs; null counts as empty.  lower: every letter in lower case."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield Run(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def words(run: Run, inside: np.ndarray) -> Words:
    """The words of a run; inside: for each of the 256 bytes, if it is part of a word."""
    begin, end, owner = borders(run, inside)
    return Words(begin, end, owner, spans(run.data, begin, end))


def borders(run: Run, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a run begin and end, and their rows."""
    data, offsets = run.data, run.offsets
    n = len(data)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    solid = inside[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]  # a word never goes on from one row to the next
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """The number of each span of bytes."""
    if total is None:
        total = prefix_sums(data)
    inverse = _powers(_room(len(data)))[1]
    raw = (total[end] - total[begin]) * inverse[begin]
    return mix(raw + (end - begin).astype(np.uint64) * _U(0xA0761D6478BD642F))


def _room(n: int) -> int:
    return max(2 * CHUNK_BYTES, 1 << max(n, 1).bit_length())


def prefix_sums(data: np.ndarray) -> np.ndarray:
    powers = _powers(_room(len(data)))[0]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_letters()[data] * powers[: len(data)], out=total[1:])
    return total


#: The white space of the n-gram operators; every other byte is part of a word.
BLANK_BYTES = (0x20, *range(0x09, 0x0E))


@lru_cache(maxsize=1)
def not_blank() -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    inside[list(BLANK_BYTES)] = False
    return inside


@lru_cache(maxsize=1)
def letters_and_digits() -> np.ndarray:
    """Bytes of words without punctuation: ASCII letters and digits, and all of other scripts."""
    inside = np.zeros(256, dtype=bool)
    inside[128:] = True
    for a, b in (("a", "z"), ("A", "Z"), ("0", "9")):
        inside[ord(a) : ord(b) + 1] = True
    return inside


@lru_cache(maxsize=1)
def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def gram_sets(run: Run, size: int, seed: int = 0) -> Iterator[np.ndarray]:
    """For each row of a run, the sorted distinct numbers of its word n-grams.

    Words are split at white space only, with A-Z in lower case.  A row with fewer than ``size`` words has its whole sequence as
    one gram; a row without words has none."""
    lowered = Run(run.first, ascii_lower()[run.data], run.offsets)
    found = words(lowered, not_blank())
    counts = found.counts(run.rows)
    weights = mix(np.arange(1, size + 2, dtype=np.uint64) * _U(0xE7037ED1A0B428DB)) | _U(1)
    n = len(found.value)
    grams = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        grams += found.value[j : j + len(grams)] * weights[j]
    grams = mix(grams + _U(seed))
    ends = np.cumsum(counts)
    for k, to in zip(counts.tolist(), ends.tolist(), strict=True):
        at = to - k
        if k >= size:
            gram = np.sort(grams[at : to - size + 1])
            keep = np.ones(len(gram), dtype=bool)
            keep[1:] = gram[1:] != gram[:-1]
            yield gram[keep]
        elif k:
            short = np.add.reduce(found.value[at:to] * weights[:k], keepdims=True) + weights[size : size + 1] * _U(k)
            yield mix(short + _U(seed))
        else:
            yield grams[:0]
