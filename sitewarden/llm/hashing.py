"""Vectorised hashing of the words of Arrow string columns.

Everything works on the UTF-8 bytes of a whole batch at once; no Python object
is made per word. Hashes have 64 bits and depend on the words alone, so they
agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BLOCK_BYTES = 1 << 16
BATCH_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all bits."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * _GOLD) | U(1)


_BYTE = numbers(256, 1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_POWER = U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U(1)], np.full(n, U(base))]))


_UP, _DOWN = (_powers(p, 2 * BLOCK_BYTES) for p in (int(_POWER), pow(int(_POWER), -1, 1 << 64)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins (one more at the end). A null is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    if column.null_count:  # a null may span bytes
        return text_bytes(pa.array([x or "" for x in column.to_pylist()], column.type))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of text, of one row at least."""
    sizes = batch.column(column)
    _, offsets = text_bytes(sizes) if batch.num_rows else (None, np.zeros(1, np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
        end = max(begin + 1, min(end, batch.num_rows))
        yield batch.slice(begin, end - begin)
        begin = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: hash, text number, first byte, end. Words end at the six separators and at text ends."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, none
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = solid[inner]  # a text may begin right after another's last word
    starts = np.flatnonzero(begins)
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    before = offsets[1:-1] - 1
    before = before[before >= 0]
    stops[before] = solid[before]
    ends = np.flatnonzero(stops) + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    out = np.empty(len(starts), U)
    table = _LOWER_BYTE if lower else _BYTE
    with np.errstate(over="ignore"):
        k = 0
        while k < len(starts):  # blocks of whole words: a word's hash is sum(byte * power ** place), from prefix sums
            first = starts[k]
            end = max(k + 1, int(np.searchsorted(ends, first + BLOCK_BYTES, "right")))
            s, e = starts[k:end] - first, ends[k:end] - first
            block = table[data[first : ends[end - 1]]]
            up, down = (_UP, _DOWN) if len(block) < len(_UP) else (_powers(p, len(block)) for p in (int(_POWER), int(_DOWN[1])))
            prefix = np.zeros(len(block) + 1, U)
            np.cumsum(block * up[: len(block)], out=prefix[1:])
            out[k:end] = mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(U) * _GOLD)
            k = end
    return out, text, starts, ends


def smallest(rank: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` consecutive numbers, the place of the smallest by their upper 40 bits; the first of equal ones."""
    n = len(rank) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for k in range(0, n, 1 << 16):
        low = rank[k : k + (1 << 16) + width - 1]
        low = (low >> U(24) << U(24)) | np.arange(len(low), dtype=U)
        reach = 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        out[k : k + len(low)] = (low & U((1 << 24) - 1)).astype(np.int64) + k
    return out


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``size``-word shingles of each text, ascending, and the bounds of each text.

    A text of fewer words, but at least one, has its whole sequence as its one shingle.
    """
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - size + 1)
        grams = hashes[:n].copy()
        for j in range(1, size):
            grams = grams * _M2 + hashes[j : j + n]
        grams = mix(grams)
        found = []
        for i in range(n_texts):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= size:
                found.append(np.unique(grams[a : b - size + 1]))
            elif b > a:
                whole = U(b - a)
                for h in hashes[a:b]:
                    whole = whole * _M1 + h
                found.append(mix(np.array([whole], U)))
            else:
                found.append(np.zeros(0, U))
    sizes = np.cumsum([0] + [len(f) for f in found])
    return (np.concatenate(found) if found else np.zeros(0, U)), sizes
