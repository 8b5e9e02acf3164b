"""Hierarchical multi-length packing of token sequences.

Each document's ids end with one separator.  Whole windows of the longest tier
leave first; the remainder is routed to the smallest tier that holds it.  From
the longest tier down, each remainder opens a sequence of its tier and the gap
is filled with remainders of the same or shorter tiers, best fit first; when
none fits, one is cut to fill the gap exactly.  What is left in the end is cut
into descending powers of two.  As every tier is a power of two, nothing needs
padding.  Sequences, longest first, are then dealt to step groups of equally
many tokens.

Plan: documents go to buckets by a hash of id and text (one shuffle of the texts, a
task a bucket) and each bucket is packed on its own, so no task holds more than a bucket
and a lost executor redoes the same buckets with the same result.  Buckets have
`bucket_bytes`, more only where that would make over a million of them.

Edge cases: a null or empty text is one separator; repeated ids are documents
of their own; a null id is an id like any other, and such rows are dealt by their texts;
a very long text is packed whole by one task; ties in length go by id and text; other
columns are ignored; an empty table gives an empty result.
"""

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmspark.llm import _text as T
from mmspark.llm._spark import ready
from mmspark.llm.bpe import codec

TIERS = (4096, 2048, 1024, 512)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (length, pieces), a piece as (document, start, length); every length is a power of two."""
    top, out = tiers[0], []
    shelves: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # of (length, document, start), ascending
    for d, n in enumerate(lengths):
        whole = n // top * top
        out += [(top, [(d, s, top)]) for s in range(0, whole, top)]
        if n > whole:
            shelves[max(i for i, t in enumerate(tiers) if t >= n - whole)].append((n - whole, d, whole))
    for shelf in shelves:
        shelf.sort()

    def take(gap: int, level: int) -> tuple[int, int, int] | None:
        """The longest remainder of this tier or a shorter one that fits; else one cut to the gap."""
        for shelf in shelves[level:]:
            if (i := bisect.bisect_right(shelf, (gap, 1 << 62, 0))) > 0:
                return shelf.pop(i - 1)
        for low, shelf in reversed([*enumerate(shelves)][level:]):
            if shelf:
                n, d, s = shelf.pop()
                rest = (n - gap, d, s + gap)
                bisect.insort(shelves[max(i for i, t in enumerate(tiers) if t >= rest[0] and i >= low)], rest)
                return gap, d, s
        return None

    for level, size in enumerate(tiers):
        while shelves[level]:
            n, d, s = shelves[level].pop()
            pieces, gap = [(d, s, n)], size - n
            while gap and (got := take(gap, level)):
                pieces.append((got[1], got[2], got[0]))
                gap -= got[0]
            if not gap:
                out.append((size, pieces))
                continue
            for bit in reversed(range((size - gap).bit_length())):  # the last of all
                if not (size - gap) >> bit & 1:
                    continue
                room, mine = 1 << bit, []
                while room:
                    d, s, n = pieces.pop()
                    use = min(n, room)
                    mine.append((d, s, use))
                    room -= use
                    if n > use:
                        pieces.append((d, s + use, n - use))
                out.append((1 << bit, mine))
    out.sort(key=lambda x: -x[0])
    return out


def packed(docs: DataFrame, vocabulary: str, separator: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16, bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, step_group."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0
    n = int(max(1, -(-total // max(bucket_bytes, total // 1_000_000))))

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        c, docs_ids = codec(vocabulary), []
        for _, data, off in T.documents(table.to_batches()):
            ids, at = c.encode(data, off)
            docs_ids += [np.append(ids[a:b], np.uint32(separator)).astype("<u4") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        c.forget()
        lengths = [len(x) for x in docs_ids]
        rows: list[tuple] = []
        spent = 0
        for q, (size, pieces) in enumerate(pack(lengths, tiers)):
            offset = 0
            for d, s, k in pieces:
                rows.append((d, s, k, zlib.crc32(docs_ids[d][s : s + k].tobytes()), lengths[d], (bucket << 32) + q, offset, size, (bucket << 32) + spent // step_tokens))
                offset += k
            spent += size
        cols = [np.array(x, np.int64) for x in zip(*rows, strict=True)]
        return pa.table([table.column("doc_id").take(pa.array(cols[0])), *map(pa.array, cols[1:])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("bucket")
    return docs.select("doc_id", "text", bucket).repartitionById(n, F.col("bucket")).groupBy("bucket").applyInArrow(run, SCHEMA)
