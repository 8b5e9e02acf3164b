"""Exact substring de-duplication over fixed windows of words.

Every window of ``window`` words gets a rolling (Rabin-Karp) hash.  A word goes
when a window that covers it also starts in a document with a smaller id.

Plan.  Documents are dealt to chunks by a hash of id and text.  A chunk sorts the
distinct rolling hashes of its windows, cut to the bits that the total asks for (a
false hit in 256), and sends each slice of the hash space, delta coded, to the
task that owns it; a passage copied all over a chunk is sent once.  The owner
answers with one bit a hash: does another chunk have it?  That only chooses
candidates.  For these, a chunk sends the whole rolling hash, a BLAKE2b of the
words under a key drawn for the run, and its smallest id; windows are equal if all 128
bits are.  The owner answers with the windows that a smaller id elsewhere has.
The chunk, whose text comes from the same exchange, adds what it knows itself
and merges the repeated windows into maximal removal intervals.  Nothing is
collected.

Scale.  Shuffled: the texts once, 3 to 5 bytes a distinct window, one bit back;
about 22 bytes a candidate, 16 back for those that go.  A hot passage costs one
entry a chunk, however many copies there are.  See ``_exchange`` for the sizes.

Edge cases: null or empty texts have no words and come back with zero counts
and an empty text; texts shorter than a window lose nothing; rows with one id
are one document's worth of order (neither removes from the other); rows with
a null id neither remove nor lose words; a very long text is one task's, so memory
grows with the longest; other columns of the input are ignored; an empty table
gives an empty result.
"""

import secrets
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmspark.llm import _exchange as X
from mmspark.llm import _text as T
from mmspark.llm._spark import ready

SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"
CLAIM = "owner int, chunk int, hashes binary, words binary, least binary"
GONE = "chunk int, hashes binary, words binary"


class _Chunk:
    """The windows of one chunk of documents."""

    def __init__(self, table: pa.Table, window: int, key: bytes):
        self.ids = table.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        data, off = T.buffers(table.column("text"))
        parts, hashes, ats, docs = [], [], [], []
        base = 0
        for i, _, d, o in T.slices(data, off):
            starts, ends, first = T.words(d, o)
            h, at, doc = T.window_hashes(T.word_hashes(d, starts, ends), first, window)
            hashes.append(h), ats.append(at + base), docs.append(doc + i)
            parts.append((d, o, starts, ends, first, base))
            base += len(starts)
        self.parts, self.n_words, self.window, self.key = parts, base, window, key
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.hash, self.at, self.doc = join(hashes, np.uint64), join(ats, np.int64), join(docs, np.int64)

    def shared_inside(self) -> np.ndarray:
        """Which windows' hashes documents of another id in the chunk have too."""
        order = np.argsort(self.hash, kind="stable")
        if not len(order):
            return np.zeros(0, bool)
        h, ids = self.hash[order], self.ids[self.doc[order]]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        several = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin)
        out = np.empty(len(order), bool)
        out[order] = np.repeat(several, np.diff(np.append(begin, len(h))))
        return out

    def words_of(self, which: np.ndarray) -> np.ndarray:
        """64 bits of the keyed BLAKE2b of the words of windows (places in `hash`, ascending)."""
        out, key, w, digest = [], self.key, self.window - 1, blake2b
        for k, (d, _, starts, ends, _, base) in enumerate(self.parts):
            last = self.parts[k + 1][5] if k + 1 < len(self.parts) else self.n_words
            at = self.at[which]
            mine = at[(at >= base) & (at < last)] - base
            if len(mine):
                view, begin, end = T.single_spaced(d, starts, ends)
                out += [digest(view[a:b], digest_size=8, key=key).digest() for a, b in zip(begin[mine].tolist(), end[mine + w].tolist(), strict=True)]
        return np.frombuffer(b"".join(out), "<u8").astype(np.uint64)


def _classes(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first places in it) of equal pairs."""
    order = np.lexsort((words, hashes))
    h, w = hashes[order], words[order]
    new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])) if len(h) else np.zeros(0, bool)
    return order, np.flatnonzero(new)


def _answer_claims(table: pa.Table) -> pa.Table:
    """For each chunk, the windows that another chunk has with a smaller id."""
    hashes = [X.undeltas(b.as_py()) for b in table.column("hashes")]
    n = np.array([len(x) for x in hashes])
    chunk = np.repeat(table.column("chunk").to_numpy(), n)
    h = np.concatenate(hashes)
    w, least = (np.frombuffer(b"".join(table.column(c).to_pylist()), f"<{t}8") for c, t in (("words", "u"), ("least", "i")))
    order, begin = _classes(h, w)
    smallest = np.minimum.reduceat(least[order], begin)
    gone = np.empty(len(h), bool)
    gone[order] = np.repeat(smallest, np.diff(np.append(begin, len(h)))) < least[order]
    owner = table.column("owner")[0].as_py()
    out: dict[str, list] = {"chunk": [], "hashes": [], "words": [], "owner": []}
    for c in np.unique(chunk[gone]).tolist():
        mine = gone & (chunk == c) if len(n) < 64 else np.flatnonzero(gone)[chunk[gone] == c]
        out["chunk"].append(c), out["hashes"].append(h[mine].astype("<u8").tobytes()), out["words"].append(w[mine].tobytes()), out["owner"].append(owner)
    return pa.table({"chunk": pa.array(out["chunk"], pa.int32()), "owner": pa.array(out["owner"], pa.int32()), "hashes": pa.array(out["hashes"], pa.binary()), "words": pa.array(out["words"], pa.binary())})


def substring_dedup(docs: DataFrame, window: int = 13, chunk_bytes: int = 6 << 20, slice_hashes: int = 1 << 20) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_text (kept words joined by one space), removed (word intervals, end exclusive)."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bytes_ = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    total = bytes_ / 6  # about so many windows
    chunks = int(max(1, -(-bytes_ // (6 * X.piece(total, chunk_bytes // 6)))))
    slice_size = X.piece(total, slice_hashes)
    bits = X.slice_bits(total, slice_size)
    width = min(64, max(bits + 8, int(np.ceil(np.log2(max(total, 2)))) + 8))
    key = secrets.token_bytes(16)
    short = lambda h: h >> T.U(64 - width)

    def ask(table: pa.Table) -> pa.Table:
        return X.ask(T.ascending(short(_Chunk(table, window, key).hash)), table.column("chunk")[0].as_py(), bits, width)

    def claim(table: pa.Table, answers: pa.Table) -> pa.Table:
        none = pa.table({"owner": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("hashes", "words", "least")}})
        if not table.num_rows or not answers.num_rows:
            return none
        c = _Chunk(table, window, key)
        unique = T.ascending(short(c.hash))
        which = np.flatnonzero(T.members(short(c.hash), unique[X.read(answers, len(unique))]))
        if not len(which):
            return none
        h, w, ids = c.hash[which], c.words_of(which), c.ids[c.doc[which]]
        order, begin = _classes(h, w)
        least = np.minimum.reduceat(ids[order], begin)
        h, w = h[order[begin]], w[order[begin]]
        owners, at = X.split(h, bits)
        low = h & T.U(2 ** (64 - bits) - 1)
        rows = [(X.deltas(x), y.astype("<u8").tobytes(), z.astype("<i8").tobytes()) for x, y, z in zip(*(np.split(v, at[1:]) for v in (low, w, least)), strict=True)]
        return pa.table({"owner": pa.array(owners, pa.int32()), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(rows), pa.int32()), **{n: pa.array([r[k] for r in rows], pa.binary()) for k, n in enumerate(("hashes", "words", "least"))}})

    def cut(table: pa.Table, gone: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64())})
        c = _Chunk(table, window, key)
        low, high, owner = (gone.column(x).to_pylist() for x in ("hashes", "words", "owner"))
        lost_h = np.concatenate([np.frombuffer(x, "<u8") + (T.U(o) << T.U(64 - bits)) for x, o in zip(low, owner, strict=True)]) if low else np.zeros(0, np.uint64)
        lost_w = np.frombuffer(b"".join(high), "<u8")
        which = np.flatnonzero(c.shared_inside() | T.members(c.hash, np.sort(lost_h)))
        h, w, ids = c.hash[which], c.words_of(which), c.ids[c.doc[which]]
        order, begin = _classes(np.concatenate([h, lost_h]), np.concatenate([w, lost_w]))
        theirs = np.arange(len(order)) >= len(which)
        ids = np.concatenate([ids, np.full(len(lost_h), np.iinfo(np.int64).max)])
        sizes = np.diff(np.append(begin, len(order)))
        goes = np.zeros(len(order), bool)
        if len(order):
            goes[order] = np.repeat(np.maximum.reduceat(theirs[order], begin), sizes) | (np.repeat(np.minimum.reduceat(ids[order], begin), sizes) < ids[order])
        at = c.at[which[goes[: len(which)]]]
        step = np.zeros(c.n_words + window + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
        removed = np.cumsum(step)[: c.n_words] > 0
        n_words, n_removed, texts, spans = [], [], [], []
        for d, o, starts, ends, first, base in c.parts:
            r = removed[base : base + len(starts)]
            acc = np.concatenate([[0], np.cumsum(r)])
            n_words.append(np.diff(first)), n_removed.append(acc[first[1:]] - acc[first[:-1]])
            texts.append(T.strings(*T.joined(d, o, starts, ends, first, ~r)))
            for k in range(len(first) - 1):
                x = r[first[k] : first[k + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], x, [False]]).astype(np.int8))).tolist() if n_removed[-1][k] else []
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        T.release()
        return pa.table({"doc_id": pa.array(c.ids, pa.int64()), "n_words": pa.array(np.concatenate(n_words), pa.int64()), "n_removed": pa.array(np.concatenate(n_removed), pa.int64()), "kept_text": pa.chunked_array(texts).cast(pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    tasks = chunks
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")
    known = docs.where("doc_id is not null").select("doc_id", "text", dealt).repartition(tasks, "chunk")
    asked = known.groupBy("chunk").applyInArrow(ask, X.ASKED)
    answers = asked.groupBy("owner").applyInArrow(X.in_other_chunk, X.ANSWERED).repartition(tasks, "chunk")
    claims = known.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(claim, CLAIM)
    gone = claims.groupBy("owner").applyInArrow(_answer_claims, GONE + ", owner int").repartition(tasks, "chunk")
    out = known.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(cut, SCHEMA)
    w = r"[^\x20\x09-\x0D]+"
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(w), F.lit(0))
    anon = docs.where("doc_id is null").select("doc_id", F.size(found).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(found, " ").alias("kept_text"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("removed"))
    return out.unionByName(anon)
