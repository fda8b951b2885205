"""Vectorised tokenising and hashing of UTF-8 texts with numpy (no per-word Python).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; letters A-Z count as a-z.
Hashes have 64 bits, are the same on every machine, and are computed for a whole Arrow buffer at
once: sum(T[byte] * P**position) over a word, shifted to position 0, then mixed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

WINDOW = 1 << 18
_P = 0x9E3779B97F4A7C55 | 1
_PINV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of the word-like tokens that classifiers read: every ASCII byte that is no letter or digit.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_TABLE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z hash as a-z
_TABLE[_SPACE] = 0
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 2 * WINDOW:
            _powers[name] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _windows(raw: np.ndarray, offs: np.ndarray, space: np.ndarray):
    """Byte ranges of about WINDOW that end where a row ends or before a space."""
    p, n = 0, len(raw)
    while p < n:
        q = int(offs[np.searchsorted(offs, p + WINDOW, "right") - 1])
        if q <= p:  # one long row
            q = min(p + WINDOW, int(offs[np.searchsorted(offs, p, "right")]))
            if q < n:
                back = np.flatnonzero(space[raw[p:q]])
                if len(back) and back[-1] > 0:
                    q = p + int(back[-1])
                else:
                    end = int(offs[np.searchsorted(offs, p, "right")])
                    ahead = np.flatnonzero(space[raw[q:end]])
                    q = q + int(ahead[0]) if len(ahead) else end
        yield p, q
        p = q


def token_spans(raw: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; a word never crosses a row."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, q in _windows(raw, offs, space):
        solid = ~space[raw[p:q]]
        cut = np.zeros(q - p + 1, bool)
        cut[0] = cut[-1] = True
        inner = offs[np.searchsorted(offs, p) : np.searchsorted(offs, q, "right")] - p
        cut[inner] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | cut[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | cut[1:-1]
        starts.append(np.flatnonzero(first) + p)
        ends.append(np.flatnonzero(last) + p + 1)
    return np.concatenate(starts), np.concatenate(ends)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the given ascending, disjoint spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        p = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, p + WINDOW, "right")))
        q = int(ends[j - 1])
        run = np.zeros(q - p + 1, np.uint64)
        np.cumsum(_TABLE[raw[p:q]] * _power(_P, q - p, "p"), out=run[1:])
        s, e = starts[i:j] - p, ends[i:j] - p
        out[i:j] = (run[e] - run[s]) * _power(_PINV, q - p + 1, "inv")[s]
        i = j
    return mix(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column and, for each of its n rows, the n+1 word offsets."""
    raw, offs = utf8(column)
    starts, ends = token_spans(raw, offs)
    return span_hashes(raw, starts, ends), np.searchsorted(starts, offs)


def shingle_hashes(words: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles, in order with repeats, and the n+1 offsets.

    A row with 1 to k-1 words has one shingle, its whole sequence; a row without words has none.
    """
    n = np.diff(offs)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_offs = np.concatenate([[0], np.cumsum(count)])
    mult = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(k)]
    if len(words) >= k:
        every = words[: len(words) - k + 1] * mult[0]
        for i in range(1, k):
            every += words[i : len(words) - k + 1 + i] * mult[i]
        every = mix(every)
    else:
        every = np.zeros(0, np.uint64)
    full = n >= k
    inside = np.repeat(offs[:-1][full], n[full] - k + 1) + _ramp(n[full] - k + 1)
    out = np.empty(int(out_offs[-1]), np.uint64)
    where = np.repeat(out_offs[:-1][full], n[full] - k + 1) + _ramp(n[full] - k + 1)
    out[where] = every[inside]
    for r in np.flatnonzero(~full & (n > 0)):
        x = np.uint64(n[r])
        own = np.array([x], np.uint64)
        for i in range(int(n[r])):
            own += words[offs[r] + i : offs[r] + i + 1] * mult[i]
        out[out_offs[r]] = mix(own)[0]
    return out, out_offs


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


ramp = _ramp


def distinct_sets(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the n+1 offsets."""
    parts = [np.unique(values[s:e]) for s, e in zip(offs[:-1], offs[1:], strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def crc_mod(doc_id: int | None, m: int) -> int:
    """crc32 of an id's decimal text, modulo m (null: of the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def to_i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def to_u64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)
