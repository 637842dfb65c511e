"""Vectorised byte kernels over Arrow string columns.

All kernels work on the concatenated UTF-8 bytes of many rows at once, in slices
of bounded size, so the Python cost is per slice rather than per row or word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once (a longer single row makes a slice of its own).
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_T = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_T_LOWER = _T[_LOWER]
#: White space of the word contract: U+0020 and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_pow = np.ones(1, U64)
_ipow = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^(n-1) and their inverses mod 2^64, grown by doubling."""
    global _pow, _ipow
    while len(_pow) < n:
        k = len(_pow)
        up, down = U64(pow(_P, k, 1 << 64)), U64(pow(_PINV, k, 1 << 64))
        _pow = np.concatenate([_pow, _pow * up])
        _ipow = np.concatenate([_ipow, _ipow * down])
    return _pow[:n], _ipow[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting (quicker here than a hash table)."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column; null counts as empty."""
    if len(column) == 0:
        return
    column = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(max(b, a + 1), len(column))
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def prefix_hash(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """H with H[j]-H[i] = sum of T[byte_k] * P^k for i <= k < j."""
    h = np.empty(len(buf) + 1, U64)
    h[0] = 0
    np.cumsum((_T_LOWER if lower else _T)[buf] * _powers(len(buf))[0], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    v = (h[ends] - h[starts]) * _powers(len(h))[1][starts]
    return mix(v + (ends - starts).astype(U64))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+``, and word offsets by row."""
    n = len(buf)
    space = np.ones(n + 1, bool)
    space[:n] = _SPACE[buf]
    first = ~space[:n]
    first[1:] &= space[: n - 1]
    last = ~space[:n]
    last &= space[1:]
    cut = offs[(offs > 0) & (offs < n)]
    first[cut] |= ~space[cut]
    last[cut - 1] |= ~space[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased words and word offsets by row."""
    starts, ends, at = word_spans(buf, offs)
    return span_hash(prefix_hash(buf, lower=True), starts, ends), at


#: Letters and digits of ASCII, and every byte of other characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_words(buf: np.ndarray, offs: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased runs of letters and digits, and offsets by row; with ``prefix``, a second
    column of hashes of the first so many bytes of each."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _WORD[buf]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offs[(offs > 0) & (offs < n)]
    first[cut] |= inside[cut + 1]
    last[cut - 1] |= inside[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = prefix_hash(buf, lower=True)
    words = span_hash(h, starts, ends)
    if prefix:
        words = np.stack([words, mix(span_hash(h, starts, np.minimum(ends, starts + prefix)) ^ U64(prefix))], 1)
    return words, np.searchsorted(starts, offs)


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``size``-word shingle and shingle offsets by row.

    A row with 1 to size-1 words has one shingle, its whole sequence; a row
    without words has none.
    """
    n = len(words)
    full = np.zeros(max(n - size + 1, 0), U64)
    for k in range(size):
        full = full * U64(0xD1342543DE82EF95) + words[k : k + len(full)] if len(full) else full
    full = mix(full)
    count = np.diff(at)
    keep = np.maximum(count - size + 1, 0)
    short = (count > 0) & (count < size)
    out_at = np.concatenate([[0], np.cumsum(np.where(short, 1, keep))])
    out = np.empty(out_at[-1], U64)
    rows = np.flatnonzero(keep)
    if len(rows):
        lens = keep[rows]
        within = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        out[np.repeat(out_at[rows], lens) + within] = full[np.repeat(at[rows], lens) + within]
    for r in np.flatnonzero(short):
        h = 0x1234567
        for w in words[at[r] : at[r + 1]].tolist():
            h = (h * 0xD1342543DE82EF95 + w) & (1 << 64) - 1
        out[out_at[r]] = mix(np.array([(h + count[r].item()) & (1 << 64) - 1], U64))[0]
    return out, out_at


def row_index(at: np.ndarray) -> np.ndarray:
    """The row of each item, from offsets by row."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
