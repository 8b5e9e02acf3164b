"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers.  A block of candidates keeps, for each
dimension, the top bits of the component (above the block's minimum) as bitmap
slices, one bit a row.  For a query, the slices are added with the weights of
its components (complemented slices for negative ones) by carry-save adders on
bitmaps, which gives the coarse score of all rows of the block as slices of a
sum.  The k-th largest coarse score is found from the most significant slice
downward.  What the dropped bits can add is bounded, so every row whose coarse
score comes within that bound of the k-th is a boundary row, and those few are
resolved with exact integer products.  Ties go to the smaller id.

Plan: rows are dealt to blocks of candidates by a hash, and the stated queries
are copied to every block, thousands to a task; a task returns k rows a query.
Candidates are copied only once for each `queries_a_task` queries.  A last window over
k rows a block merges the blocks.

Edge cases: null or empty vectors, and those with a null or non-finite component
take no part; components of any finite size are scored exactly (rows with
one from 2**22 / scale on in Python integers, and a score outside the range of a long
is given as the nearest long, though ordered as it is); a query meets the vectors
of its own length only, and every row but its own: of rows with its id and vector one is
its own; rows that repeat a query's id are queries of their own; a null id is neither
query nor candidate; fewer candidates than k give fewer rows; other columns are
ignored; an empty table gives an empty result.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mmspark.llm._spark import ready
from mmspark.llm.embedding_dedup import finite, matrix


def pack_bits(mask: np.ndarray) -> np.ndarray:
    """Booleans along the last axis to 64-bit words."""
    pad = -mask.shape[-1] % 64
    mask = np.concatenate([mask, np.zeros((*mask.shape[:-1], pad), bool)], -1)
    # a transposed mask padded by a single column stays transposed, and so does what packbits makes of it
    return np.ascontiguousarray(np.packbits(mask, axis=-1, bitorder="little")).view(np.uint64)


class SlicedIndex:
    """Bitmap slices of the top bits of integer rows."""

    def __init__(self, values: np.ndarray, keep_bits: int = 6):
        self.values, self.n = values, len(values)
        self.low = values.min(0)
        above = values - self.low
        bits = max(1, int(above.max()).bit_length())
        self.bits = min(keep_bits, bits)
        self.drop = bits - self.bits
        coarse = above >> self.drop
        plain = np.stack([pack_bits(((coarse >> s) & 1).T.astype(bool)) for s in range(self.bits)], 1)  # [dim, slice, word]
        self.slices = np.concatenate([plain, ~plain])  # the second half is complemented
        self.all = pack_bits(np.ones(self.n, bool))

    def add(self, query: np.ndarray) -> np.ndarray:
        """Slices, least first, of sum |q| * (coarse, or its complement where q < 0)."""
        size = np.abs(query)
        dim = np.arange(len(query)) + len(query) * (query < 0)
        columns: list[list[np.ndarray]] = [[] for _ in range(80)]
        for b in range(int(size.max(initial=0)).bit_length()):
            use = dim[(size >> b) & 1 == 1]
            for s in range(self.bits):
                if len(use):
                    columns[b + s].append(self.slices[use, s])
        out = []
        last = max((i for i, c in enumerate(columns) if c), default=-1)
        p = 0
        while p <= last:
            rows = np.concatenate(columns[p]) if columns[p] else np.zeros((0, len(self.all)), np.uint64)
            while len(rows) > 1:
                if len(rows) == 2:
                    rows, carry = rows[:1] ^ rows[1:], rows[:1] & rows[1:]
                else:
                    m = len(rows) // 3
                    x, y, z = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
                    xy = x ^ y
                    carry = (x & y) | (z & xy)
                    rows = np.concatenate([xy ^ z, rows[3 * m :]])
                columns[p + 1].append(carry)
                last = max(last, p + 1)
            out.append(rows[0] if len(rows) else np.zeros(len(self.all), np.uint64))
            p += 1
        return np.array(out) if out else np.zeros((0, len(self.all)), np.uint64)

    def kth(self, total: np.ndarray, rows: np.ndarray, k: int) -> int:
        """The k-th largest value of the sum among the rows of a bitmap, slice by slice from the most significant."""
        sure, tied, value = 0, rows, 0
        for s in reversed(range(len(total))):
            ones = tied & total[s]
            have = int(np.bitwise_count(ones).sum())
            if sure + have >= k:
                tied, value = ones, value | 1 << s
            else:
                sure, tied = sure + have, tied & ~total[s]
        return value

    def at_least(self, total: np.ndarray, rows: np.ndarray, value: int) -> np.ndarray:
        """The rows of a bitmap whose sum is at least value."""
        if value <= 0:
            return rows
        if value >> len(total):
            return np.zeros_like(rows)
        above, equal = np.zeros_like(rows), rows.copy()
        for s in reversed(range(len(total))):
            if value >> s & 1:
                equal &= total[s]
            else:
                above |= equal & total[s]
                equal &= ~total[s]
        return above | equal

    def top(self, query: np.ndarray, ids: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the k best rows but `own`; ids break ties."""
        rows = self.all
        if own >= 0:
            rows = rows.copy()
            rows[own >> 6] &= ~np.uint64(1 << (own & 63))
        total = self.add(query)
        k_here = min(k, self.n - (own >= 0))
        if k_here <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # score = const + 2**drop * coarse + (what the dropped bits add)
        spread = int(np.abs(query).sum()) * ((1 << self.drop) - 1)
        floor = self.kth(total, rows, k_here) - -(-spread // (1 << self.drop))
        close = self.at_least(total, rows, floor)
        found = np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little")[: self.n])
        scores = self.values[found] @ query
        order = np.lexsort((ids[found], -scores))[:k]
        return found[order], scores[order]


WIDE = 1 << 22


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in integers: int64, or Python's where a component is WIDE."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if not len(y) or np.abs(y).max() < WIDE:
        return y.astype(np.int64)
    exact = lambda v, w: int(w) if math.isfinite(w) else int(v) * scale  # noqa: E731 - so large a float is an integer
    return np.array([[exact(v, w) for v, w in zip(a, b, strict=True)] for a, b in zip(x.tolist(), y.tolist(), strict=True)], object)


class Block:
    """One block of candidates: a sliced index of the plain rows, the wide ones beside it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: int, keep_bits: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        with np.errstate(over="ignore"):
            wide = (np.abs(np.floor(scale * vectors)) >= WIDE).any(1)
        self.ids, self.wide_ids = ids[~wide], ids[wide]
        self.values, self.wide = quantised(vectors[~wide], scale), quantised(vectors[wide], scale)
        self.index = SlicedIndex(self.values, keep_bits) if len(self.ids) else None

    def top(self, q: int, w: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(-score, id) of the k best rows for the query of id q and vector w, without one row equal to it."""
        own = lambda ids, v: next((i for i in range(*np.searchsorted(ids, [q, q + 1])) if (v[i] == w).all()), -1)
        plain = w.dtype != object
        found: list[tuple[int, int]] = []
        if self.index is not None and plain:
            at, scores = self.index.top(w, self.ids, k, own(self.ids, self.values))
            found += zip((-scores).tolist(), self.ids[at].tolist(), strict=True)
        for ids, v in ((self.wide_ids, self.wide), *([] if plain else [(self.ids, self.values)])):
            if len(ids):
                scores = (v.astype(object) @ w.astype(object)).tolist()
                mine = own(ids, v)
                found += [(-x, i) for j, (x, i) in enumerate(zip(scores, ids.tolist(), strict=True)) if j != mine]
        return sorted(found)[:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = 1 << 13, queries_a_task: int = 1 << 12, keep_bits: int = 6) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of floor(scale * component) for each query row."""
    ready(vectors.sparkSession)
    element = vectors.schema["embedding"].dataType.elementType
    kind = "array<float>" if element.typeName() == "float" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite("v")).select("vec_id", "q", F.size("v").alias("d"), "v", F.xxhash64("vec_id", "v").alias("h"))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("q").alias("m"))
    most = sizes.agg(F.max("n").alias("n"), F.max("m").alias("m")).first()
    blocks, chunks = max(1, -(-(most["n"] or 0) // block)), max(1, -(-(most["m"] or 0) // queries_a_task))
    part = lambda count: F.pmod("h", F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    other = F.pmod(F.xxhash64("h"), F.lit(chunks)).cast("int")  # independent of the block
    left = rows.select("vec_id", "v", "d", part(blocks).alias("block"), every(chunks).alias("chunk"))
    # equal query rows have equal answers: one is asked, and its rows come back as often as it is there
    asked = rows.where("q").groupBy("vec_id", "h", "d", "v").agg(F.count("*").alias("copies"))
    right = asked.select(F.col("vec_id").alias("query"), "h", "copies", F.col("v").alias("given"), F.col("d").alias("length"), every(blocks).alias("at"), other.alias("part"))

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and queries.num_rows:
            here = Block(candidates.column("vec_id").to_numpy(), matrix(candidates.column("v")), scale, keep_bits)
            given = matrix(queries.column("given"))
            for i, (q, h, copies) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("query", "h", "copies")), strict=True)):
                for least, vec in here.top(q, quantised(given[i : i + 1], scale)[0], k):
                    out.append((q, h, copies, vec, -least))
        clipped = [max(-(2**63), min(2**63 - 1, r[4])) for r in out]
        cols = [pa.array([r[c] for r in out], pa.int64()) for c in range(4)]
        return pa.table([*cols, pa.array(clipped, pa.int64()), pa.array([str(r[4]) if r[4] != s else None for r, s in zip(out, clipped, strict=True)], pa.string())], names=["query_id", "h", "copies", "vec_id", "score", "whole"])

    best = left.groupBy("d", "block", "chunk").cogroup(right.groupBy("length", "at", "part")).applyInArrow(run, "query_id long, h long, copies long, vec_id long, score long, whole string")
    size = F.length("whole") * F.sign("score")  # scores beyond a long: by digits, then as text, the other way round below zero
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), F.desc(F.coalesce(size, F.lit(0.0))), F.desc(F.when(F.col("score") > 0, F.col("whole"))), F.when(F.col("score") < 0, F.col("whole")), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
