"""Vectorised text work on Arrow batches: word spans, word hashes, shingles, code points.

Everything runs on the UTF-8 bytes of a whole batch at once, in blocks of bounded size, so that no
Python loop runs per word. A block never cuts a word: a document longer than a block is cut at a
separator, and a word longer than a block makes its block longer.

A word is a run of letters, marks and digits of any script, in lower case. In scripts that put no spaces
between words (LONE) every character is a word of its own, so five words are five characters there.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII letters and digits.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = True
#: Code points of scripts without spaces, first and last: Thai and Lao, Tibetan, Myanmar, Khmer, New Tai Lue to
#: Tai Tham, kana and CJK with their extensions, compatibility ideographs, half-width kana, and planes 2 and 3.
LONE = ((0x0E01, 0x0EFF), (0x0F40, 0x0FBC), (0x1000, 0x109F), (0x1780, 0x17D3), (0x1950, 0x1AAD), (0x3005, 0x3007), (0x3021, 0x312F),
        (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over the whole output."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    size = BLOCK + 1
    while size < n + 1:
        size *= 2
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, _INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            tables.append(out)
        _powers[size] = tuple(tables)
    return _powers[size]


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lower(column: pa.Array) -> pa.Array:
    """A string column in lower case, by Unicode's rules; null is empty."""
    column = pc.fill_null(column, "")
    data, _ = arrow_bytes(column)
    return pc.utf8_lower(column) if len(data) and data.max() >= 128 else pc.ascii_lower(column)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals in lower case, each in its place."""
    out = _LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[at] += 32
    return out


@functools.cache
def _classes() -> np.ndarray:
    """By code point: 0 separator, 1 part of a word, 2 a word of its own."""
    out = np.zeros(0x110000, np.uint8)
    out[:0x20000] = [unicodedata.category(chr(c))[0] in "LMN" for c in range(0x20000)]
    for first, last in LONE:
        out[first : last + 1][out[first : last + 1] == 1] = 2
    out[0x20000:0x40000] = 2
    return out


def is_letter(points: np.ndarray) -> np.ndarray:
    """Whether code points are letters, marks or digits."""
    if not len(points) or points.max() < 128:
        return WORDLIKE[points]
    return _classes()[points] > 0


def _beyond(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths in bytes and code points of the characters beyond ASCII."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.uint32)
    more = 1 + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64)
    end = len(data) - 1
    tail = [data[np.minimum(at + k, end)].astype(np.uint32) & 0x3F for k in (1, 2, 3)]
    two = ((lead & 0x1F) << 6) | tail[0]
    three = ((lead & 0x0F) << 12) | (tail[0] << 6) | tail[1]
    four = ((lead & 0x07) << 18) | (tail[0] << 12) | (tail[1] << 6) | tail[2]
    return at, more + 1, np.where(more == 1, two, np.where(more == 2, three, np.minimum(four, 0x10FFFF)))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of rows of UTF-8 bytes, and the rows' offsets in them."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint32), offsets
    first = (data & 0xC0) != 0x80
    out = data.astype(np.uint32)
    at, _, found = _beyond(data)
    out[at] = found
    return out[first], np.append(0, np.cumsum(first))[offsets]


def word_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Masks over bytes: inside a word; first and last byte of a character that is a word (None: none is)."""
    inside = WORDLIKE[data]
    at, length, code = _beyond(data)
    if not len(at):
        return inside, None, None
    kind = _classes()[code]
    for k in range(4):
        has = at[(kind > 0) & (length > k)] + k
        inside[has[has < len(data)]] = True
    lone = kind == 2
    if not lone.any():
        return inside, None, None
    begin, finish = np.zeros(len(data), bool), np.zeros(len(data), bool)
    begin[at[lone]] = True
    finish[np.minimum(at[lone] + length[lone], len(data)) - 1] = True
    return inside, begin, finish


def blocks(inside: np.ndarray, offsets: np.ndarray):
    """(from, to) byte ranges of at most about BLOCK bytes that cut no word; inside: mask over the bytes."""
    at, end = 0, len(inside)
    while at < end:
        to = min(at + BLOCK, end)
        if to < end:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:  # one document fills the block
                stop = int(offsets[k + 1])
                free = np.flatnonzero(~inside[at:to])
                if len(free):
                    to = at + int(free[-1]) + 1
                else:
                    later = np.flatnonzero(~inside[to:stop])
                    to = to + int(later[0]) + 1 if len(later) else stop
        yield at, to
        at = to


def spans(inside: np.ndarray, offsets: np.ndarray, lo: int, hi: int, begin: np.ndarray | None = None, finish: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in bytes lo to hi, counted from lo."""
    is_in = inside[lo:hi]
    cuts = offsets[(offsets > lo) & (offsets < hi)] - lo
    before = np.empty_like(is_in)
    before[0] = False
    before[1:] = is_in[:-1]
    before[cuts] = False
    after = np.empty_like(is_in)
    after[-1] = False
    after[:-1] = is_in[1:]
    after[cuts - 1] = False
    if begin is not None:
        begin, finish = begin[lo:hi], finish[lo:hi]
        before[1:] &= ~finish[:-1]
        before &= ~begin
        after[:-1] &= ~begin[1:]
        after &= ~finish
    return np.flatnonzero(is_in & ~before), np.flatnonzero(is_in & ~after) + 1


def hash_spans(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a rolling sum of byte codes, finalised with the length."""
    power, inverse = _power_tables(len(block))
    total = np.empty(len(block) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[block] * power[: len(block)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-case rows in order, and the offsets of the rows in them."""
    found, starts_all = [], []
    inside, begin, finish = word_bytes(data)
    for lo, hi in blocks(inside, offsets):
        starts, ends = spans(inside, offsets, lo, hi, begin, finish)
        if len(starts):
            found.append(hash_spans(data[lo:hi], starts, ends))
            starts_all.append(starts + lo)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(starts_all), offsets)


def word_rows(column: pa.Array):
    """(first row, row after the last, word hashes, offsets of the rows in them) of a string column, about BLOCK bytes at once."""
    data, offsets = arrow_bytes(lower(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, to, *word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


_ROLE = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of every run of `width` words; a shorter text is one run of all its words."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    out = words[: n - k + 1] * _ROLE[0]
    for i in range(1, k):
        out = out + words[i : n - k + 1 + i] * _ROLE[i]
    return mix(out + np.uint64(k))
