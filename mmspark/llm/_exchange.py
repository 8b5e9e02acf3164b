"""Who else has this number?  A request and reply over slices of the number space.

Rows are dealt to chunks; a chunk sends its sorted distinct numbers, one blob for
each owner of a slice of the number space, delta coded.  The owner answers each
blob with one bit a number, in the same order.  What is copied all over a chunk is
sent once, so hot numbers cost one entry a chunk, and neither side holds more than
a chunk or a slice.

Blobs number chunks times owners, so a blob must hold enough numbers: from about
LEAST**-1 * size**2 numbers in all, chunks and slices grow with the square root of the
total (at 100 TB of text, 1.7e13 windows, to 2.3e7 numbers each, in blobs of 32).
"""

import numpy as np
import pyarrow as pa

from mmspark.llm import _text as T

ASKED = "owner int, chunk int, hashes binary"
ANSWERED = "chunk int, owner int, bits binary, n long"
LEAST = 32


def piece(total: float, size: int) -> int:
    """Numbers in a chunk or a slice: `size`, or as many as give blobs of LEAST numbers."""
    return max(size, int(np.ceil(np.sqrt(LEAST * max(total, 0.0)))))


def slice_bits(total: float, size: int, least: int = 64) -> int:
    """log2 of the number of owners for so many numbers."""
    return int(np.ceil(np.log2(max(least, total / size))))


def deltas(x: np.ndarray) -> bytes:
    """Sorted distinct integers: a width byte, then the steps in that many bytes each."""
    d = x.copy()
    d[1:] -= x[:-1]
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def undeltas(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : b[0]] = raw
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def split(unique: np.ndarray, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(owners, first place of each) of sorted numbers of `width` bits."""
    owner = (unique >> T.U(width - bits)).astype(np.int64)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1]).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    return owner[begin], begin


def ask(unique: np.ndarray, chunk: int, bits: int, width: int = 64) -> pa.Table:
    """The blobs of a chunk, from its sorted distinct numbers of `width` bits."""
    owners, begin = split(unique, bits, width)
    parts = np.split(unique & T.U(2 ** (width - bits) - 1), begin[1:]) if len(begin) else []
    return pa.table({"owner": pa.array(owners, pa.int32()), "chunk": pa.array([chunk] * len(parts), pa.int32()), "hashes": pa.array([deltas(x) for x in parts], pa.binary())})


def in_other_chunk(table: pa.Table) -> pa.Table:
    """One bit a number: does another chunk have it?"""
    table = table.sort_by("chunk")
    lists = [undeltas(b.as_py()) for b in table.column("hashes")]
    h = np.concatenate(lists)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    had = np.zeros(len(h), bool)
    had[order[1:]] = same
    had[order[:-1]] |= same
    bits = np.split(had, np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"chunk": table.column("chunk"), "owner": table.column("owner"), "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary()), "n": pa.array([len(x) for x in bits], pa.int64())})


def read(answers: pa.Table, n: int) -> np.ndarray:
    """The replies to a chunk, in the order of its sorted distinct numbers."""
    out = np.zeros(n, bool)
    at = 0
    for bits, k in zip(*(answers.sort_by("owner").column(c).to_pylist() for c in ("bits", "n")), strict=True):
        out[at : at + k] = np.unpackbits(np.frombuffer(bits, np.uint8), count=k).astype(bool)
        at += k
    return out
