"""Whole-batch text primitives over Arrow string columns.

Everything works on the UTF-8 bytes of a batch at once, so that no Python object is made for a word. Words and
word sequences are named by 64-bit hashes (a polynomial over mixed byte values, then a finaliser): two given
texts collide with a probability of about 2**-64, which is the only way in which results drawn from equal hashes
can differ from results drawn from equal words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def stream64(seed: int, n: int) -> np.ndarray:
    """n pseudo-random unsigned 64-bit integers that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + _U(seed % 2**64)) * _U(0x9E3779B97F4A7C15))


_BYTE = stream64(11, 256)
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, (n - 1).bit_length())
        table = np.ones(size, np.uint64)
        filled, step = 1, base
        while filled < size:
            table[filled : 2 * filled] = table[:filled] * _U(step)
            filled, step = 2 * filled, step * step % 2**64
        _powers[base] = table
    return table


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_ranges(offsets: np.ndarray, most: int, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most so many bytes and rows, of one row at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, min(low + rows, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1))
        yield low, high
        low = high


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of word bytes; a run never crosses a row. is_word: flag by byte value."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    flag = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start, end = flag.copy(), flag.copy()
    start[1:] &= ~flag[:-1] | cut[1:n]
    end[:-1] &= ~flag[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 19, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of the bytes (or other values that table mixes) of each span; spans ascend and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + block, side="right")))
        a, b = int(starts[low]), int(ends[high - 1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * _power_table(_P, b - a)[: b - a], out=total[1:])
        s, e = starts[low:high] - a, ends[low:high] - a
        h = (total[e] - total[s]) * _power_table(_P_INVERSE, b - a)[s]
        out[low:high] = mix64(h + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        low = high
    return out


#: Stands for a missing word where a row has fewer words than a shingle.
_PAD = int(stream64(97, 1)[0])


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words of a row, and their rows. A row of 1 to k - 1 words has one, of all its words."""
    if not len(words):
        return words, rows
    factor = _power_table(0xA24BAED4963EE407 | 1, k + 1)
    n = len(words)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, n])
    out, of = [], []
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += words[j : n - k + 1 + j] * factor[j]
        whole = rows[: n - k + 1] == rows[k - 1 :]
        out.append(mix64(h[whole]))
        of.append(rows[: n - k + 1][whole])
    short = np.flatnonzero(count < k)
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for j in range(k):
            at = np.minimum(first[short] + j, n - 1)
            h += np.where(j < count[short], words[at], _U(_PAD)) * factor[j]
        out.append(mix64(h))
        of.append(rows[first[short]])
    hashes, owner = np.concatenate(out), np.concatenate(of)
    if len(out) == 2 and len(out[0]):
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def lower_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_flags(pattern_of_separators: bytes) -> np.ndarray:
    """True for each byte value outside the given separators."""
    flags = np.ones(256, bool)
    flags[np.frombuffer(pattern_of_separators, np.uint8)] = False
    return flags


LOWER = lower_ascii()
#: Words are runs without white space: [^\x20\x09-\x0D]+
NOT_SPACE = byte_flags(b" \t\n\v\f\r")
#: Words are runs of digits, letters and all that is outside ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = byte_flags(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def gather(offsets: np.ndarray, values: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given lists one after another, and the offsets of these lists in them."""
    length = offsets[lists + 1] - offsets[lists]
    out = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(length, out=out[1:])
    return values[np.arange(out[-1]) + np.repeat(offsets[lists] - out[:-1], length)], out


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
