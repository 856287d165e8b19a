"""Word scanning and rolling fingerprints over the UTF-8 bytes of an Arrow text column.

Everything is a whole-array NumPy operation on one slice of a batch; slices end at document
boundaries and hold about ``SLICE_BYTES`` of text, so memory does not follow the batch size.
A fingerprint is a polynomial in an odd base modulo 2**64 followed by a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW_BASES = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.arange(256, dtype=np.uint8)
FOLDED = PLAIN.copy()
FOLDED[ord("A") : ord("Z") + 1] += 32
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("a") : ord("z") + 1] = ALNUM[ord("A") : ord("Z") + 1] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, i < n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << n.bit_length())
        out = []
        for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[int(base)] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Fingerprint of ``values[start:end]`` for each span."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Slice:
    """Documents ``lo:hi`` of a batch; byte and word positions count from the slice's first byte and word."""

    lo: int
    hi: int
    data: np.ndarray  # bytes
    offsets: np.ndarray  # first byte of each document, and the end
    null: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def __len__(self) -> int:
        return self.hi - self.lo


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into runs of whole documents; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    null = np.asarray(pc.is_null(column))
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], null[lo:hi])
        lo = hi


@dataclass
class Words:
    start: np.ndarray  # byte positions
    end: np.ndarray
    first: np.ndarray  # index of each document's first word, and the number of words
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(part: Slice, in_word: np.ndarray, fold: np.ndarray = PLAIN) -> Words:
    """Maximal runs of bytes marked in ``in_word``, never across documents, fingerprinted after ``fold``."""
    inside = in_word[part.data]
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = part.offsets[(part.offsets > 0) & (part.offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, part.offsets)
    return Words(start, end, first, spans_hash(fold[part.data].astype(np.uint64) + np.uint64(1), start, end, BYTE_BASE))


def space_words(part: Slice) -> Words:
    return find_words(part, ~SPACE)


def folded_words(part: Slice) -> Words:
    """Lower-cased ASCII letters, digits and everything beyond ASCII."""
    return find_words(part, ALNUM, FOLDED)


def window_starts(words: Words, width: int) -> np.ndarray:
    """Word positions at which ``width`` words of one document begin."""
    n = len(words.hash)
    doc_end = np.repeat(words.first[1:], words.counts)
    return np.flatnonzero(np.arange(n) + width <= doc_end)


def window_hash(words: Words, starts: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    return spans_hash(words.hash, starts, starts + width, WINDOW_BASES[family])


def covered(n: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in some ``[start, start + width)``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0
