"""Vectorised word and window hashing over Arrow string buffers.

Everything here works on the UTF-8 bytes of a whole column slice at once, so the
cost per byte is a few numpy passes and no Python string is ever built.  Words
are maximal runs of bytes other than space and 0x09-0x0D, which is the contract
pattern ``[^\\x20\\x09-\\x0D]+`` (all separators are ASCII, so bytes suffice).

Hashes are 64-bit: each byte maps to a random odd-ish 64-bit value, a polynomial
modulo 2**64 runs over the word, and the result goes through a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_WORD_BASE_2 = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1

#: Bytes of text handled by one kernel call; the numpy temporaries need about 60 bytes for each.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit splitmix finaliser (a bijection)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TABLE_FOLDED = _TABLE[_FOLD]
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in [0, n]."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            ups = np.full(size, base, dtype=U64)
            ups[0] = 1
            downs = np.full(size, inverse, dtype=U64)
            downs[0] = 1
            have = (np.cumprod(ups, dtype=U64), np.cumprod(downs, dtype=U64))
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of some rows: ``starts``/``ends`` (byte positions), ``row`` and ``hashes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.data, self.offsets, self.n_rows = data, offsets, len(offsets) - 1
        n = len(data)
        sep = _SEPARATOR[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        first = np.empty(n, dtype=bool)
        last = np.empty(n, dtype=bool)
        if n:
            first[0] = True
            first[1:] = sep[:-1]
            first |= edge[:n]
            first &= ~sep
            last[-1] = True
            last[:-1] = sep[1:]
            last |= edge[1:]
            last &= ~sep
        self.separators = sep
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.row, minlength=self.n_rows).astype(np.int64)
        self.first_word = np.concatenate(([0], np.cumsum(self.counts)))
        self._table = _TABLE_FOLDED if fold else _TABLE
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            n = len(self.data)
            with np.errstate(over="ignore"):
                up, down = powers(_BYTE_BASE, n)
                sums = np.zeros(n + 1, dtype=U64)
                np.cumsum(self._table[self.data] * up[:n], out=sums[1:])
                raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
                self._hashes = mix(raw + (self.ends - self.starts).astype(U64) * U64(0xA0761D6478BD642F))
        return self._hashes

    def windows(self, width: int, second: bool = False) -> np.ndarray:
        """Hash of the ``width`` consecutive words from each word on (meaningless where they leave the row)."""
        h = self.hashes
        m = len(h) - width + 1
        if m <= 0:
            return np.zeros(0, dtype=U64)
        with np.errstate(over="ignore"):
            up, down = powers(_WORD_BASE_2 if second else _WORD_BASE, len(h))
            sums = np.zeros(len(h) + 1, dtype=U64)
            np.cumsum(h * up[: len(h)], out=sums[1:])
            return mix((sums[width:] - sums[:-width]) * down[:m])

    def inside(self, width: int) -> np.ndarray:
        """Whether the window from each word on stays in its row."""
        m = len(self.row) - width + 1
        return self.row[: max(m, 0)] == self.row[width - 1 :] if m > 0 else np.zeros(0, dtype=bool)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each row: (hashes sorted within a row, row offsets).

    A row with 1 to k-1 words has its whole word sequence as its one shingle; a
    row without words has none.
    """
    w = Words(data, offsets, fold)
    ok = w.inside(k)
    rows = w.row[: len(ok)][ok]
    values = w.windows(k)[ok]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        extra = np.empty(len(short), dtype=U64)
        with np.errstate(over="ignore"):
            up, _ = powers(_WORD_BASE, k)
            for i, r in enumerate(short):
                h = w.hashes[w.first_word[r] : w.first_word[r + 1]]
                extra[i] = (h * up[: len(h)]).sum(dtype=U64) + U64(len(h)) * U64(0x2545F4914F6CDD1D)
        rows, values = np.concatenate((rows, short)), np.concatenate((values, mix(extra)))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    if len(rows):
        keep = np.ones(len(rows), dtype=bool)
        keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[keep], values[keep]
    return values, np.searchsorted(rows, np.arange(w.n_rows + 1))
