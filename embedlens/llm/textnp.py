"""Words and word hashes of many texts at once, in numpy over the UTF-8 bytes.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``. Hashes are 64 bits. Spans of up to 8 bytes are their own bytes and length, mixed
by a bijection, so no two of them share a hash; longer ones are hashed by xxh3.

Bytes are worked on in passes of about ``PASS``, cut at white space, so what a pass needs besides the words is bounded however long a text
is. Empty data has no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

U = np.uint64
PASS = 1 << 19
SHORT = 64  # bytes of a span that is compared, or hashed, eight bytes at a time
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = ~_ALNUM[33:127]
#: Every ASCII byte but letters and digits.
NOT_ALNUM = ~_ALNUM & (np.arange(256) < 128)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """``hash``, byte ``start`` and ``end`` of each word; ``first[d]:first[d+1]`` are those of text d."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, cut_marks: bool = False, gaps: np.ndarray = _SPACE, quick: bool = False) -> Words:
    """``cut_marks`` also cuts between an ASCII letter or digit and an ASCII mark that follows it; ``gaps`` tells which bytes no word has;
    ``quick`` is as in ``span_hash``."""
    found, a = [], 0
    while a < len(data):
        b = _gap_after(data, a + PASS, gaps)
        piece, inner = data[a:b], offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b)] - a
        inside = ~gaps[piece]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        if cut_marks:
            marks = _ALNUM[piece[:-1]] & _MARK[piece[1:]]
            begins[1:] |= marks
            ends[:-1] |= marks
        begins[inner] = inside[inner]
        ends[inner - 1] = inside[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        found.append((span_hash(_LOWER[piece] if lower else piece, start, end, *[quick] * quick), start + a, end + a))
        a = b
    h, start, end = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Words(h, start, end, np.searchsorted(start, offsets))


def _gap_after(data: np.ndarray, at: int, gaps: np.ndarray) -> int:
    """The first place from ``at`` on with a byte that no word has, or the end."""
    while at < len(data):
        space = gaps[data[at : at + 4096]]
        if space.any():
            return at + int(space.argmax())
        at += 4096
    return len(data)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, quick: bool = False) -> np.ndarray:
    """Hash of each ``data[start:end]``. ``quick``: spans of 9 to ``SHORT`` bytes are hashed in numpy, eight bytes at a time, not by xxh3; for
    those who compare the spans themselves."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    from_each = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    size = (end - start).astype(np.int64)
    value = from_each[start] & _FIRST_BYTES[np.minimum(size, 8)]
    value |= np.where(size < 8, size, 0).astype(U) << U(56)
    out = mix(value)
    # eight bytes that look like fewer with their count
    long = np.flatnonzero((size > 8) | ((size == 8) & (value >> U(56) < U(8))))
    if quick:
        some = long[(size[long] > 8) & (size[long] <= SHORT)]
        out[some] = size[some].astype(U)
        for j in range(0, int(size[some].max(initial=0)), 8):
            some = some[size[some] > j]
            out[some] = mix(out[some] * _STEPS[0] + (from_each[start[some] + j] & _FIRST_BYTES[np.minimum(size[some] - j, 8)]))
        long = long[(size[long] <= 8) | (size[long] > SHORT)]
    if len(long):
        raw, digest = padded.tobytes(), xxhash.xxh3_64_intdigest
        out[long] = np.fromiter((digest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())), U, len(long))
    return out


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``a[a_start:a_start + size]`` and ``b[b_start:b_start + size]`` hold the same bytes, for each span."""
    out, at = np.ones(len(size), bool), np.flatnonzero((size > 0) & (size <= SHORT))
    for j in range(0, SHORT, 8):  # eight bytes of each at a time
        at = at[size[at] > j] if j else at
        if not len(at):
            break
        out[at] &= (_eight(a, a_start[at] + j) ^ _eight(b, b_start[at] + j)) & _FIRST_BYTES[np.minimum(size[at] - j, 8)] == 0
    long = np.flatnonzero(size > SHORT)
    if len(long):
        out[long] = _equal_long(a, a_start[long], b, b_start[long], size[long])
    return out


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, with zeros beyond the end."""
    data = np.ascontiguousarray(data if len(data) >= 8 else np.append(data, np.zeros(8, np.uint8)))
    last = len(data) - 8
    from_each = np.ndarray((last + 1,), "<u8", buffer=data, strides=(1,))
    beyond = np.maximum(at - last, 0)
    return from_each[at - beyond] >> (8 * beyond).astype(U)


def _equal_long(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out, each = np.ones(len(size), bool), max(1, PASS)
    ends = np.cumsum(size)
    i = 0
    while i < len(size):  # about a pass of bytes at a time
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + each, "right")))
        n = size[i:j]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = a[np.repeat(a_start[i:j], n) + inner] != b[np.repeat(b_start[i:j], n) + inner]
        out[i + np.repeat(np.arange(j - i), n)[differ]] = False
        i = j
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, with the total last."""
    out = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all windows of ``size`` words inside a text, and the windows' hashes."""
    last = np.repeat(w.first[1:], np.diff(w.first))
    at = np.flatnonzero(np.arange(len(w.hash)) + size <= last)
    h = np.zeros(len(at), U)
    for j in range(size):
        h += w.hash[at + j] * _STEPS[j % 5] * U(2 * (j // 5) + 1)
    return at, mix(h)


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; with fewer than ``size`` words, the whole sequence as one."""
    at, h = windows(w, size)
    bounds = np.searchsorted(at, w.first)
    out = []
    for d in range(len(w.first) - 1):
        a, b = bounds[d], bounds[d + 1]
        if a < b:
            out.append(np.unique(h[a:b]))
        else:
            short = w.hash[w.first[d] : w.first[d + 1]]
            k = len(short)
            out.append(mix(np.array([(short * _STEPS[:k]).sum(dtype=U) + U(k)], U)) if k and k < size <= 5 else mix(_fold(short)) if k else short)
    return out


def _fold(short: np.ndarray) -> np.ndarray:
    h = np.full(1, len(short), U)
    for x in short:
        h = mix(h * U(0x9FB21C651E98DF25) + x)
    return h
