"""Words of whole Arrow text columns as 64-bit hashes, computed with numpy over the UTF-8 bytes.

A batch is never turned into Python strings: the byte buffer is classified by a lookup table, words are runs of
non-separator bytes inside one document, and each word's hash is a sum of table[byte] * random[position] modulo 2**64,
mixed at the end. The multipliers are independent of each other: with powers of one base, whatever it is, words like the
Thue-Morse word and its complement fall together modulo 2**64. Byte work is done in pieces of about ``PIECE`` bytes cut between words, so the memory used beside the
batch itself is a small multiple of the piece, whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.zeros(0, np.uint64)
_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

#: Contract words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Alignment words: letters, digits and any non-ASCII byte.
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _multipliers(n: int) -> np.ndarray:
    """Odd pseudo-random numbers for positions 0 to n-1 at least, the same ones in every process."""
    global _MULTIPLIERS
    if len(_MULTIPLIERS) < n:
        _MULTIPLIERS = mix((np.arange(1, max(n, 2 * len(_MULTIPLIERS), 64) + 1, dtype=np.uint64)) * _STEP) | np.uint64(1)
    return _MULTIPLIERS


def column(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, offsets relative to the bytes; a null is an empty text."""
    array = batch_column
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_starts(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position of each word, and for each document the number of words before it (length n+1)."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    start[edges] = inside[edges]
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, separators: np.ndarray, lower: bool = True) -> np.ndarray:
    """The hash of each word; separators weigh nothing, so a word may be read up to the next word's start."""
    table = np.where(separators, np.uint64(0), _TABLE[LOWER] if lower else _TABLE)
    out = np.empty(len(starts), np.uint64)
    ends = np.append(starts[1:], len(raw))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        lengths = ends[a:b] - starts[a:b]
        place = np.arange(hi - lo) - np.repeat(starts[a:b] - lo, lengths)
        weight = table[raw[lo:hi]]
        weight *= _multipliers(int(lengths.max()))[place]
        out[a:b] = np.add.reduceat(weight, starts[a:b] - lo)
        a = b
    return mix(out)


def prefix_hashes(raw: np.ndarray, starts: np.ndarray, separators: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the hash of each word's first ``size`` bytes (0 for words no longer than that); case as it is."""
    table = np.where(separators, np.uint64(0), _TABLE)
    out = [np.zeros(len(starts), np.uint64) for _ in sizes]
    if not len(starts):
        return out
    lengths = np.add.reduceat((~separators)[raw], starts, dtype=np.int64)
    multipliers = _multipliers(max(sizes) + 1)
    total = np.zeros(len(starts), np.uint64)
    for j in range(max(sizes)):
        long = np.flatnonzero(lengths > j)
        total[long] += table[raw[starts[long] + j]] * multipliers[j]
        if j + 1 in sizes:
            longer = lengths > j + 1
            out[sizes.index(j + 1)][longer] = mix(total[longer] + np.uint64(j + 1))
    return out


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (length len(words)-k+1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _SHINGLE[0]
    for j in range(1, k):
        out += words[j : n + j] * _SHINGLE[j]
    return mix(out)


def whole(words: np.ndarray) -> np.ndarray:
    """Hash of a sequence shorter than a shingle, as one; never equal to that of another length but by chance."""
    return mix(np.array([np.add.reduce(words * _SHINGLE[32 : 32 + len(words)]) + np.uint64(len(words))], np.uint64))


def shingle_sets(text: pa.Array, k: int, separators: np.ndarray = SPACE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: k-word runs, or the whole sequence when it has fewer words."""
    raw, offsets = column(text)
    starts, at = word_starts(raw, offsets, separators)
    words = word_hashes(raw, starts, separators)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(windows(words[a:b], k)))
        elif b > a:
            out.append(whole(words[a:b]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
