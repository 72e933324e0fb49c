"""Vectorised text primitives over Arrow string columns.

Every function works on blocks of about ``BLOCK_BYTES`` of text, so the memory
of a Python worker follows the block (or the longest single text), not the
Arrow batch.  A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: The whitespace of ``[^\x20\x09-\x0D]+``.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    return _mix(x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64))


_BYTE_CODE = mix64(np.arange(256), 1)
_BASE = 0x5851F42D4C957F2D


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def blocks(column: pa.Array):
    """Yields (first row, bytes, offsets of the rows within them) for each block."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a block, and the first word of each row (one more entry than rows)."""
    word = ~_IS_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edges = offsets[:-1][(offsets[:-1] < offsets[1:])]
    start[edges] = word[edges]
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.flatnonzero(start[at])
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    code = data[at]
    if lower:
        code = _LOWER[code]
    hashes = _mix(np.add.reduceat(_BYTE_CODE[code] * _powers(int(length.max()))[place], first))
    return hashes, np.searchsorted(at[first], offsets, "left")


def shingle_sets(hashes: np.ndarray, firsts: np.ndarray, words: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word ``words``-grams; all words as one where there are fewer."""
    out, none = [], np.zeros(0, np.uint64)
    n = len(hashes)
    grams = np.zeros(max(0, n - words + 1), np.uint64)
    for i in range(words if len(grams) else 0):
        grams += hashes[i : i + len(grams)] * np.uint64(2 * (0x632BE59BD9B4E019 * (i + 1) % 2**62) + 1)
    grams = _mix(grams)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= words:
            s = np.sort(grams[a : b - words + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            odd = np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
            out.append(mix64((hashes[a:b] * odd).sum(dtype=np.uint64, keepdims=True), b - a))
        else:
            out.append(none)
    return out


def char_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, runs of whitespace as one space and one at either end; the rows' offsets."""
    texts = [f" {' '.join((t or '').lower().split())} " for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def gram_buckets(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket (of 2**bits) of the n-gram of codes that begins at each place."""
    m = max(0, len(codes) - n + 1)
    h = np.full(m, 0x9E3779B1 * n % 2**32, np.uint32)
    for i in range(n):
        h *= np.uint32(0x01000193)
        h += codes[i : i + m].astype(np.uint32, copy=False)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h >> np.uint32(32 - bits)
