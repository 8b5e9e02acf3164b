"""Byte-level text kernels that work on whole Arrow batches with numpy.

Words are maximal runs of bytes outside ``{0x20, 0x09..0x0D}``; those six are
ASCII, so cutting UTF-8 at them equals cutting code points.  Every function
takes the concatenated bytes of a slice of documents and their offsets, so the
Python cost is per slice and not per word.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_WINDOW_BASE = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offs, data = text.buffers()
    if offs is None or not len(text):
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole documents of about max_bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def release() -> None:
    """Give freed memory back to the system, at the end of a task: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def documents(batches: Iterable[pa.RecordBatch], max_bytes: int = 1 << 20):
    """(batch slice, bytes, offsets) for each run of documents; the text column is named ``text``."""
    for batch in batches:
        data, off = buffers(batch.column(batch.schema.get_field_index("text")))
        for i, j, d, o in slices(data, off, max_bytes):
            yield batch.slice(i, j - i), d, o
    release()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the index of each document's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_WS[data]
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < n)]
    begin[edge] = solid[edge]
    finish[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, off)


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def parts(data: np.ndarray, off: np.ndarray, plain: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(parts of words, first part of each document).

    Words are cut between a letter (ASCII or Latin-1) and an ASCII mark other
    than the apostrophe, either way round, and ASCII capitals become small
    where no combining mark can follow.  If plain, whole words are left as they
    are.
    """
    starts, _, _ = words(data, off)
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(len(off), np.int64)
    solid = ~_WS[data]
    if not plain:
        upper = (data >= 65) & (data <= 90)
        upper[:-1] &= data[1:] < 128  # the next document's first byte, at a document's end: only a missed fold
        upper[-1] = False
        data = np.where(upper, data + np.uint8(32), data)
        letter, mark = _LETTER[data], _MARK[data]
        wide = letter.copy()  # also the second byte of a Latin-1 letter
        wide[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 128) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begin = np.zeros(len(data), bool)
        begin[1:] = (wide[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        begin[starts] = True
        starts = np.flatnonzero(begin)
    place = np.cumsum(solid)
    cuts = np.append(place[starts] - 1, place[-1]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[solid])]), np.searchsorted(starts, off)



def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        out = np.full(max(n, 1 << 16), U(base & (2**64 - 1)))
        out[0] = 1
        with np.errstate(over="ignore"):
            got = np.cumprod(out, dtype=np.uint64)
        if n <= 1 << 23:
            _powers[base] = got
    return got[:n]


def ascending(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; by a sort, which is quicker here than numpy's own unique of integers."""
    s = np.sort(x)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def members(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values of x are among the sorted ones."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)  # the first k bytes of eight
_LONG = 4096


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """Keyed 64-bit hash of each word, eight bytes a step: a bijection for words of at most eight bytes of one length."""
    size = ends - starts
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(size.astype(np.uint64) * U(0xA0761D6478BD642F) + U(key & 2**64 - 1))
    live, at = np.flatnonzero(size <= _LONG), 0
    while len(live):
        part = eight[starts[live] + at] & _BYTES[np.minimum(size[live] - at, 8)]
        h[live] = mix(h[live] * U(_WINDOW_BASE) + part)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return h


def word_codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each word, equal for equal words only, first word of each document)."""
    found, first = parts(data, off, plain=True)
    return (found.dictionary_encode().indices.to_numpy().astype(np.int64) if len(found) else np.zeros(0, np.int64)), first


def gram_codes(codes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each n-gram, equal for equal ones only, document); a document of fewer words is one gram.

    Numbers of runs of words are the ranks of pairs of shorter runs, so nothing is hashed.
    """
    n, have, run = len(codes), 1, codes
    while have < size and len(run):
        step = min(have, size - have)
        a, b = run[: max(0, len(run) - step)], run[step:]
        run = np.unique(a * (int(run.max()) + 1) + b, return_inverse=True)[1] if len(a) else a
        have += step
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[size - 1 :] == doc[: max(0, n - size + 1)]) if n >= size else np.zeros(0, np.int64)
    short: dict[tuple, int] = {}
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    whole = [-1 - short.setdefault(tuple(codes[first[i] : first[i + 1]].tolist()), len(short)) for i in few.tolist()]
    return np.concatenate([run[at], np.array(whole, np.int64)]), np.concatenate([doc[at], few])


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """(the words with one blank between them, their starts and ends there); a document's last word may have no blank behind it."""
    keep = ~_WS[data]
    behind = ends[ends < len(data)]
    keep[behind] = True
    place = np.cumsum(keep)
    out = np.where(_WS[data], np.uint8(32), data)[keep].tobytes()
    return memoryview(out), place[starts] - 1, place[ends - 1]


def window_hashes(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start word, document) of every window of ``size`` words inside one document, by a rolling polynomial."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(_WINDOW_BASE, n), out=acc[1:])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[size - 1 :] == doc[: n - size + 1])
    w = (acc[at + size] - acc[at]) * powers(pow(_WINDOW_BASE, -1, 2**64), n + 1)[at]
    return mix(w), at, doc[at]


def joined(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the kept words of each document, joined by one space."""
    n = len(data)
    step = np.zeros(n + 2, np.int32)
    np.add.at(step, starts[keep], 1)
    np.add.at(step, ends[keep] + 1, -1)  # the byte after a word is its separator
    kept = np.flatnonzero(keep)
    doc = np.searchsorted(first, kept, "right") - 1
    last = np.ones(len(kept), bool)
    last[:-1] = doc[1:] != doc[:-1]
    np.add.at(step, ends[kept[last]], -1)
    np.add.at(step, ends[kept[last]] + 1, 1)
    mask = np.cumsum(step)[:n] > 0
    out = np.where(_WS[data], np.uint8(32), data)[mask]
    return out, np.concatenate([[0], np.cumsum(mask)])[off]


def strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A string array from bytes and offsets."""
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
