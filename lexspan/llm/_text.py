"""Byte kernels shared by the operators of this subpackage.

A batch of texts becomes one UTF-8 buffer with a space after every text, so word boundaries, word
hashes and windows are found for all texts at once by numpy. Long buffers are handled in segments
cut outside words, which bounds the temporary arrays whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche; wraps modulo 2**64."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


mix = _mix

#: One random odd factor per eight bytes of a word, by their place.
_PLACE = _mix(np.arange(1, 65537, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], _U)

Inside = Callable[[np.ndarray], np.ndarray]


def lower(b: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return b + ((b - np.uint8(65) < np.uint8(26)).view(np.uint8) << np.uint8(5))


def alnum(b: np.ndarray) -> np.ndarray:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing: digits, letters and every non-ASCII byte."""
    return (b - np.uint8(48) < np.uint8(10)) | ((b | np.uint8(32)) - np.uint8(97) < np.uint8(26)) | (b > np.uint8(127))


def spaced(b: np.ndarray) -> np.ndarray:
    """[^\\x20\\x09-\\x0D]"""
    return (b != np.uint8(32)) & (b - np.uint8(9) > np.uint8(4))


def join(texts: pa.Array | pa.ChunkedArray, between: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each followed by the byte `between`; start of each text and the end). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(offs)
    if texts.null_count:
        size = np.where(np.asarray(texts.is_valid()), size, 0)
    start = np.zeros(n + 1, np.int64)
    np.cumsum(size + 1, out=start[1:])
    out = np.full(start[-1], between, np.uint8)
    for a, b, m in zip(start.tolist(), offs.tolist(), size.tolist(), strict=False):
        out[a : a + m] = data[b : b + m]
    return out, start


def edges(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past) of the runs of True."""
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    e = np.flatnonzero(k[1:] != k[:-1]) + 1
    e = np.concatenate(([0] if k[0] else [], e, [len(k)] if k[-1] else [])).astype(np.int64)
    return e[::2], e[1::2]


def _hashes(b: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """64-bit hash of the lower-cased bytes of each word: its groups of eight bytes, mixed, each times the factor of its place."""
    low = np.zeros(len(b) + 8, np.uint8)
    low[:-8] = lower(b)
    eight = np.ndarray((len(low) - 7,), _U, low, 0, (1,))
    size = z - a
    with np.errstate(over="ignore"):
        h = _mix(eight[a] & _FIRST[np.minimum(size, 8)]) * _PLACE[0]
        rows, c = np.flatnonzero(size > 8), 1
        while len(rows):
            if c == 64:  # the rest of very long words, a word at a time
                for r in rows.tolist():
                    at = np.arange(512, int(size[r]), 8)
                    x = eight[a[r] + at] & _FIRST[np.minimum(size[r] - at, 8)]
                    h[r] += (_mix(x + (at >> 19).astype(_U)) * _PLACE[(at >> 3) & 65535]).sum(dtype=_U)
                break
            x = eight[a[rows] + 8 * c] & _FIRST[np.minimum(size[rows] - 8 * c, 8)]
            h[rows] += _mix(x) * _PLACE[c]
            c += 1
            rows = rows[size[rows] > 8 * c]
        return _mix(h + size.astype(_U))


def words(buf: np.ndarray, inside: Inside, segment: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte, byte after, 64-bit hash of the lower-cased bytes) of the words of each segment."""
    at, end = 0, len(buf)
    while at < end:
        to = min(end, at + segment)
        while to < end and inside(buf[to : to + 1])[0]:  # a word is never cut
            ahead = ~inside(buf[to : to + 65536])
            to += int(ahead.argmax()) if ahead.any() else len(ahead)
        b = buf[at:to]
        a, z = edges(inside(b))
        if len(a):
            yield a + at, z + at, _hashes(b, a, z)
        at = to


def all_words(buf: np.ndarray, inside: Inside) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words() of the whole buffer."""
    got = list(words(buf, inside))
    if not got:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))  # type: ignore[return-value]


_TURN = _mix(np.arange(11, 75, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, len(h) - n + 1 of them, whatever texts they belong to."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = h[:m] * _TURN[0]
        for i in range(1, n):
            out += h[i : i + m] * _TURN[i % 64]
    return _mix(out)


def slices(start: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most so many bytes each, or of one text."""
    i, n = 0, len(start) - 1
    while i < n:
        j = int(np.searchsorted(start, start[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
