"""BPE encoding and decoding of whole texts, exactly as the tokenizers library does.

White space never joins two pre-tokens of this vocabulary, and neither do a
plain letter and a plain punctuation mark.  So a slice of documents is cut at
those places, its distinct parts are found by one dictionary encoding, each
distinct part is encoded once per worker (a bounded cache), and the ids of all
documents are put together by one Arrow ``take``.

A pre-token longer than a leaf is encoded by tree concatenation: its halves are
encoded on their own (side by side when it is very long), then a window of
tokens around the join is encoded again and grows until its first token equals
the left half's and its last token the right half's token at that place.  A
token sequence is the BPE of its text exactly when every neighbouring pair is,
so agreement at both rims makes the whole sequence exact.

Scale: one narrow pass over the texts, no shuffle; memory is a slice of texts,
the bounded cache and the vocabulary.

Edge cases: null and empty texts encode to no ids and decode to the empty
text; repeated rows and null ids give one row each; other columns of the input
are ignored; an empty table gives an empty result.
"""

import json
import re
import struct
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmspark.llm import _text as T
from mmspark.llm._spark import ready

LEAF = 256
#: Letters whose lower case is one letter and that normalisation leaves alone, then ASCII punctuation without the apostrophe.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Codec:
    """One vocabulary file; encodes words with a bounded cache."""

    def __init__(self, path: str, cache_words: int = 250_000):
        from tokenizers import Tokenizer

        self.path = path
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.suffix = self.model.end_of_word_suffix or ""
        size = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        self.names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.width = [len(x.removesuffix(self.suffix)) for x in self.names]
        #: a token with the blank that follows it; from `size` on without, for the last of a text
        self.spoken = pa.array([x + " " for x in self.names] + self.names, pa.large_string())
        self.letters = dict(enumerate(byte_letters()))
        self.cache_words = cache_words
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def forget(self) -> None:
        """Drop the cache, at the end of a task: the worker lives on."""
        self.words.clear()
        self.pieces.clear()
        T.release()

    @cached_property
    def inner(self):
        """The merges without word ends, for what does not end a word; only long unsplit texts need it."""
        from tokenizers import models

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return models.BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]])

    # one pre-token, in byte letters ------------------------------------------------

    def leaf(self, s: str, final: bool) -> list[int]:
        return [t.id for t in (self.model if final else self.inner).tokenize(s)]

    def tree(self, s: str, final: bool = True, pool: ThreadPoolExecutor | None = None) -> list[int]:
        """Tree concatenation of one unsplit text; final: the text ends the word."""
        if len(s) <= LEAF:
            return self.leaf(s, final)
        mid = len(s) // 2
        if pool is None and len(s) > 1 << 16:
            with ThreadPoolExecutor(2) as pool:
                left, right = pool.submit(self.tree, s[:mid], False, pool), self.tree(s[mid:], final, pool)
                return self.join(s, mid, left.result(), right, final)
        return self.join(s, mid, self.tree(s[:mid], False, pool), self.tree(s[mid:], final, pool), final)

    def join(self, s: str, mid: int, left: list[int], right: list[int], final: bool) -> list[int]:
        k = 4
        while True:
            kl, kr = min(k, len(left)), min(k, len(right))
            a = mid - sum(self.width[i] for i in left[len(left) - kl :])
            b = mid + sum(self.width[i] for i in right[:kr])
            mine = self.leaf(s[a:b], final and kr == len(right))
            if (kl == len(left) or mine[0] == left[-kl]) and (kr == len(right) or mine[-1] == right[kr - 1]):
                return left[: len(left) - kl] + mine + right[kr:]
            k *= 2

    def piece(self, s: str) -> list[int]:
        got = self.pieces.get(s)
        if got is None:
            if len(s) > LEAF:
                return self.tree(s)
            if len(self.pieces) >= self.cache_words // 4:
                self.pieces.clear()
            got = self.pieces[s] = self.leaf(s, True)
        return got

    # one word: no ASCII white space inside --------------------------------------------

    def word(self, w: str) -> list[int]:
        if m := _PLAIN.fullmatch(w):
            core = m[1].lower()
            if not core.isascii():
                core = core.encode().decode("latin-1").translate(self.letters)
            return self.piece(core) + self.piece(m[2]) if m[2] else self.piece(core)
        if "<|" in w:  # perhaps a special token
            return self.tok.encode(w, add_special_tokens=False).ids
        parts = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(w))
        return [i for p, _ in parts for i in self.piece(p)]

    def part(self, b: bytes) -> bytes:
        """The ids of a part, as bytes."""
        s = b.decode("utf-8")
        ids = [t.id for t in self.model.tokenize(s)] if len(b) <= LEAF and s.isascii() and s.isalpha() and s.islower() else self.word(s)
        got = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)
        if len(b) <= 1024:
            if len(self.words) >= self.cache_words:
                self.words.clear()
            self.words[b] = got
        return got

    # documents ------------------------------------------------------------------------

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents as little-endian uint32, offsets in ids)."""
        parts, first = T.parts(data, off, plain=b"<|" in data.tobytes())  # perhaps a special token
        if not len(parts):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        coded = parts.dictionary_encode()
        known, make = self.words.get, self.part
        # an empty value is a part without ids, so only None is a miss
        values = pa.array([x if (x := known(b)) is not None else make(b) for b in coded.dictionary.to_pylist()], pa.large_binary())
        taken = values.take(coded.indices)
        _, o, ids = taken.buffers()
        ends = np.frombuffer(o, np.int64)[taken.offset : taken.offset + len(taken) + 1]
        ids = np.frombuffer(ids, "<u4", count=int(ends[-1]) // 4) if ids is not None else np.zeros(0, "<u4")
        return ids[ends[0] // 4 :], (ends[first] - ends[0]) // 4

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The text of each document: the names of its tokens, with single blanks between them."""
        which = ids.astype(np.int64)
        which[off[1:][off[1:] > off[:-1]] - 1] += len(self.names)
        spoken = self.spoken.take(pa.array(which))
        _, o, data = spoken.buffers()
        ends = np.frombuffer(o, np.int64)[spoken.offset : spoken.offset + len(spoken) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return T.strings(data[ends[0] : ends[-1]], ends[off] - ends[0])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's own codec for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def binaries(data: np.ndarray, off: np.ndarray, width: int = 4) -> pa.Array:
    raw = np.ascontiguousarray(data).view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off * width, np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def bpe_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row a document: doc_id, ids (little-endian unsigned 32-bit integers), decoded (their text again)."""
    ready(docs.sparkSession)

    def run(batches):
        c = codec(vocabulary)
        for rows, data, off in T.documents(batches):
            ids, at = c.encode(data, off)
            yield pa.RecordBatch.from_arrays([rows.column(0), binaries(ids, at), c.decode(ids, at)], ["doc_id", "ids", "decoded"])
        c.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


