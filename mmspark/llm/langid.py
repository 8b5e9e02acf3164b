"""Language identification with segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language.
The probability of a word in a language is the sum over all its segmentations
into pieces, by the forward algorithm; that of a text is the product over its
words.  The piece probabilities are fitted by expectation maximisation (forward
and backward) to the words of a bounded sample of labelled documents, and
smoothed with the pooled distribution.  A letter that no piece covers costs the
same in every language.

A word here is what remains of the letters of a token, in lower case; tokens
end at white space and between plain letters and plain marks.  A token is scored
once per worker (a bounded cache), so a text costs one dictionary encoding and
one gather.

Scale: fitting reads ``max_docs`` documents a language (expected number; they
are chosen by a hash of id and text, so no sort) and sends the ``max_words`` most frequent
words of each language among those to the driver; prediction is one narrow pass
without a shuffle.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties
go to the language that sorts first; without labelled rows all texts are
``und``; repeated rows and null ids give a row each, with answers of their own; a very
long text is scored whole, by one task; other columns are ignored, or kept if asked
for; an empty table gives an empty result.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mmspark.llm import _text as T
from mmspark.llm._spark import ready

MAX_PIECE = 12
_UNKNOWN = 1e-9
_WHOLE = 32  # letters of a word that one float64 forward pass surely holds


def core(token: str) -> str:
    """The letters of a token, in lower case."""
    t = token.lower()
    return t if t.isalpha() else "".join(c for c in t if c.isalpha())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vocabulary(path: str) -> list[str]:
    """The distinct lower-case letter pieces of a sentencepiece file; a word start is ``▁``."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    return sorted(p for p in found if 0 < len(p) <= MAX_PIECE and p.lstrip("▁").isalpha() and "▁" not in p[1:])


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(prefix hashes, lengths): hashes[i, j] is that of the first j letters of word i, word start included."""
    marked = ["▁" + w for w in words]
    n = np.array([len(w) for w in marked])
    wide = np.array(marked, dtype=f"U{n.max()}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    acc = np.zeros((len(words), wide.shape[1] + 1), np.uint64)
    np.cumsum(wide * T.powers(T._BASE, wide.shape[1]), axis=1, out=acc[:, 1:])
    return acc, n


@dataclass
class Model:
    languages: list[str]
    hashes: np.ndarray  # of the pieces, ascending
    probs: np.ndarray  # [piece, language]; the last row stands for a letter that no piece covers

    def lookup(self, acc: np.ndarray, i: int, k: int) -> np.ndarray:
        """Piece numbers of letters i..i+k of each word, or -1."""
        inv = T.powers(pow(T._BASE, -1, 2**64), acc.shape[1])
        h = T.mix((acc[:, i + k] - acc[:, i]) * inv[i] + T.U(k))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def steps(self, acc: np.ndarray, n: np.ndarray):
        """(start, letters, words, pieces) of every piece in every word, by ascending end."""
        for j in range(1, int(n.max()) + 1):
            rows = np.flatnonzero(n >= j)
            for k in range(1, min(j, MAX_PIECE) + 1):
                got = self.lookup(acc[rows], j - k, k)
                hit = got >= 0
                if k == 1:
                    yield j, k, rows, np.where(hit, got, len(self.hashes))
                elif hit.any():
                    yield j, k, rows[hit], got[hit]

    def forward(self, words: list[str], keep: bool = False) -> tuple[np.ndarray, list]:
        """(sums up to each letter, lengths and, if kept, the steps)."""
        acc, n = _codes(words)
        alpha = np.zeros((len(words), int(n.max()) + 1, len(self.languages)))
        alpha[:, 0] = 1
        kept = [n]
        for j, k, rows, pieces in self.steps(acc, n):
            alpha[rows, j] += alpha[rows, j - k] * self.probs[pieces]
            if keep:
                kept.append((j, k, rows, pieces))
        return alpha, kept

    def long(self, word: str) -> np.ndarray:
        """Log probabilities of one long word, rescaled at each letter."""
        acc, n = _codes([word])
        n = int(n[0])
        ring = [np.zeros(len(self.languages))] * MAX_PIECE + [np.ones(len(self.languages))]
        scale = np.zeros(len(self.languages))
        ids = [np.full(n, -1) for _ in range(MAX_PIECE + 1)]
        inv = T.powers(pow(T._BASE, -1, 2**64), n + 1)
        for k in range(1, min(MAX_PIECE, n) + 1):
            h = T.mix((acc[0, k : n + 1] - acc[0, : n + 1 - k]) * inv[: n + 1 - k] + T.U(k))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids[k][k - 1 :] = np.where(self.hashes[at] == h, at, -1)
        for j in range(n):
            new = ring[-1] * self.probs[ids[1][j]]  # -1 is the last row
            for k in range(2, min(j + 1, MAX_PIECE) + 1):
                if (p := ids[k][j]) >= 0:
                    new = new + ring[-k] * self.probs[p]
            ring = [x / new for x in ring[1:]] + [np.ones_like(new)]
            scale += np.log(new)
        return scale

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if 0 < len(w) < _WHOLE]
        by_length = sorted(short, key=lambda i: len(words[i]))
        for s in range(0, len(by_length), 8_000):
            part = by_length[s : s + 8_000]
            alpha, (n, *_) = self.forward([words[i] for i in part])
            out[part] = np.log(alpha[np.arange(len(part)), n])
        for i, w in enumerate(words):
            if len(w) >= _WHOLE:
                out[i] = self.long(w)
        return out


def train(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = 2, pooled: float = 0.02) -> Model:
    """Fit piece probabilities to word counts by language; of words of _WHOLE letters or more, the consecutive parts."""
    languages = sorted(counts)
    acc = np.zeros(0, np.uint64)
    marks = [np.array([ord(c) for c in p], np.uint64) for p in pieces]
    acc = np.array([np.sum(m * T.powers(T._BASE, len(m)), dtype=np.uint64) for m in marks], np.uint64)
    hashes = np.unique(T.mix(acc + np.array([len(p) for p in pieces], np.uint64)))
    model = Model(languages, hashes, np.full((len(hashes) + 1, len(languages)), 1 / max(1, len(hashes))))
    model.probs[-1] = _UNKNOWN
    data = [[(w[i : i + _WHOLE - 1], c) for w, c in counts[x].items() for i in range(0, len(w), _WHOLE - 1)] for x in languages]
    for _ in range(rounds):
        seen = np.zeros((len(hashes) + 1, len(languages)))
        for g, rows in enumerate(data):
            one = Model([languages[g]], hashes, model.probs[:, g : g + 1])
            rows.sort(key=lambda x: len(x[0]))
            for s in range(0, len(rows), 20_000):
                part = rows[s : s + 20_000]
                alpha, (n, *steps) = one.forward([w for w, _ in part], keep=True)
                alpha = alpha[:, :, 0]
                beta = np.zeros_like(alpha)
                idx = np.arange(len(part))
                beta[idx, n] = np.array([c for _, c in part]) / alpha[idx, n]
                for j, k, r, p in reversed(steps):
                    flow = one.probs[p, 0] * beta[r, j]
                    seen[:, g] += np.bincount(p, alpha[r, j - k] * flow, len(seen))
                    beta[r, j - k] += flow
        seen[-1] = 0
        share = seen / np.maximum(seen.sum(0), 1e-300)
        mean = share.mean(1, keepdims=True)
        floor = 1e-3 / max(1, len(hashes))
        model.probs = (1 - pooled) * share + pooled * mean + floor
        model.probs[-1] = _UNKNOWN
    return model


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over documents with the columns lang and text."""

    def run(batches):
        for rows, data, off in T.documents(batches):
            parts, first = T.parts(data, off)
            if not len(parts):
                continue
            lang = rows.column(rows.schema.get_field_index("lang")).take(pa.array(np.repeat(np.arange(len(off) - 1), np.diff(first))))
            words = [core(b.decode("utf-8")) for b in parts.to_pylist()]
            yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(words, pa.string())], ["lang", "word"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string").where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


def fit(labelled: DataFrame, vocabulary_path: str, max_docs: int = 300, max_words: int = 100_000) -> Model:
    """A model from about max_docs documents of each language, chosen by a hash of id and text, and their max_words most frequent words."""
    ready(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0, np.uint64), np.zeros((1, 0)))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, max_docs / n))))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counts: dict[str, dict[str, int]] = {x: {} for x in sizes}
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    rows = word_counts(sample).withColumn("place", first).where(F.col("place") <= max_words).drop("place").toArrow()
    for lang, word, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][word] = n
    return train(counts, vocabulary(vocabulary_path))


class _Scorer:
    """Scores slices of documents; keeps the scores of words."""

    def __init__(self, model: Model, cache_words: int = 120_000):
        self.model, self.cache_words = model, cache_words
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {b"": 0}
        self.table = np.zeros((1, len(self.model.languages) + 1))

    def rows(self, parts: list[bytes]) -> np.ndarray:
        """The row of the table for each part; the last column counts its letters."""
        if len(self.row) > self.cache_words:
            self.clear()
        known = self.row
        got = [known.get(b, -1) for b in parts]
        new = [i for i, x in enumerate(got) if x < 0]
        cores = [core(parts[i].decode("utf-8")) for i in new]
        todo = list(dict.fromkeys(c for c in cores if c.encode() not in known))
        if todo:
            known.update(zip((c.encode() for c in todo), range(len(self.table), len(self.table) + len(todo)), strict=True))
            self.table = np.concatenate([self.table, np.column_stack([self.model.score(todo), [len(c) for c in todo]])])
        for i, c in zip(new, cores, strict=True):
            got[i] = known[parts[i]] = known[c.encode()]
        return np.array(got, np.int64)

    def documents(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Sums over the words of each document."""
        parts, first = T.parts(data, off)
        if not len(parts):
            return np.zeros((len(off) - 1, self.table.shape[1]))
        coded = parts.dictionary_encode()
        rows = self.rows(coded.dictionary.to_pylist())
        values = self.table[rows]
        codes = coded.indices.to_numpy()
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        return np.column_stack([np.bincount(doc, values[codes, g], len(off) - 1) for g in range(values.shape[1])])


def predict(docs: DataFrame, model: Model, sharpness: float = 60.0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: the columns to keep, lang_pred, score.  score: the posterior of lang_pred, as of at most `sharpness` letters at the text's mean evidence a letter."""
    ready(docs.sparkSession)
    kept = docs.select(*(F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in keep), F.col("text").cast("string").alias("text"))
    if "text" in keep:
        kept = docs.select(*keep)
    if not model.languages:
        return kept.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        scorer = _Scorer(model)
        for rows, data, off in T.documents(batches):
            sums = scorer.documents(data, off)
            n = sums[:, -1]
            ok = n > 0
            lang = np.full(len(n), None, object)
            lang[:] = "und"
            score = np.zeros(len(n))
            if ok.any():
                ll = sums[ok, :-1]
                lang[ok] = np.array(model.languages, object)[ll.argmax(1)]
                ll = (ll - ll.max(1, keepdims=True)) * np.minimum(1, sharpness / n[ok])[:, None]
                score[ok] = 1 / np.exp(ll).sum(1)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, kept.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in five, by the checksum of its id; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
