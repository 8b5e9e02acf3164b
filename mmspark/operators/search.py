"""Ranked text search: a stored inverted index with score bounds, BM25, exact top-k that skips by the bounds (A5-A10).

The index is written once, partitioned by a hash of the term and sorted by term, so
a query reads its terms' slots only, and of those the row groups of its terms.  Beside
the postings stand each term's number of documents and its largest weight, the bound
that a query prunes with before it scores anything.
"""

import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mmspark.functions.text import tokenize
from mmspark.sources.folders import read_text, shared, write_text

K1, B = 1.2, 0.75
SLOTS = 64
POSTINGS = "slot int, term string, doc_id long, tf long, dl long"
BOUNDS = "term string, df long, most double, slot int"


@dataclass
class Index:
    """Postings (slot, term, doc_id, tf, dl), bounds (slot, term, df, most) and the figures of the collection."""

    postings: DataFrame
    bounds: DataFrame
    documents: int
    mean_length: float


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def write_index(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", terms: list[str] | None = None) -> Index:
    """Write the index of all terms, or of some, in one scan of the texts; a null text is empty."""
    spark = df.sparkSession
    tokens = tokenize(F.lower(F.coalesce(F.col(text), F.lit(""))))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), tokens.alias("t")).withColumn("dl", F.size("t").cast("long"))
    if terms is not None:
        wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
        docs = docs.withColumn("t", F.filter("t", lambda x: F.array_contains(wanted, x)))
    # the empty term stands in every document once: it carries the figures of the collection
    rows = docs.select("doc_id", "dl", F.explode(F.concat("t", F.array(F.lit("")))).alias("term")).groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    rows = rows.select("term", "doc_id", "tf", "dl", _slot(F.col("term")).alias("slot"))
    rows.repartition("slot", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("slot", "term", "doc_id").write.partitionBy("slot").parquet(f"{path}/postings")
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    every = postings.where((F.col("slot") == _slot(F.lit(""))) & (F.col("term") == ""))
    figures = every.agg(F.count("*").alias("n"), F.avg("dl").alias("m")).first()
    write_text(spark, f"{path}/figures.json", json.dumps({"documents": figures["n"], "mean_length": figures["m"] or 0.0}))
    weights = postings.where(F.col("term") != "").select("slot", "term", weight(figures["m"] or 0.0, F.col("tf"), F.col("dl")).alias("w"))
    weights.groupBy("slot", "term").agg(F.count("*").alias("df"), F.max("w").alias("most")).select("term", "df", "most", "slot").repartition("slot").sortWithinPartitions("slot", "term").write.partitionBy("slot").parquet(f"{path}/bounds")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    figures = json.loads(read_text(spark, f"{path}/figures.json"))
    return Index(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(BOUNDS).parquet(f"{path}/bounds"), figures["documents"], figures["mean_length"])


def build_index(df: DataFrame, key: str = "doc_id", text: str = "text", terms: list[str] | None = None) -> Index:
    """An index in a folder of its own."""
    return write_index(df, shared(df.sparkSession, "index"), key, text, terms)


def idf(n: int, df: Column) -> Column:
    return F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def weight(mean_length: float, tf: Column, dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean_length)))


@dataclass(frozen=True)
class Term:
    term: str
    slot: int
    df: int
    idf: float
    bound: float


def known_terms(index: Index, terms: list[str]) -> list[Term]:
    """The query's terms that the index has, by ascending bound; a row a term is read."""
    if not terms:
        return []
    wanted = index.bounds.where(F.col("slot").isin(*[r[0] for r in index.bounds.sparkSession.createDataFrame([(t,) for t in set(terms)], "t string").select(_slot(F.col("t"))).distinct().collect()]))
    rows = wanted.where(F.col("term").isin(*terms)).select("term", "slot", "df", idf(index.documents, F.col("df")).alias("idf"), "most").collect()
    return sorted((Term(r["term"], r["slot"], r["df"], r["idf"], r["idf"] * r["most"]) for r in rows), key=lambda t: (t.bound, t.term))


def scored(index: Index, terms: list[Term]) -> DataFrame:
    """(term, doc_id, part): the BM25 part of each term in each of its documents."""
    if not terms:
        return index.postings.limit(0).select("term", "doc_id", F.lit(0.0).alias("part"))
    hits = index.postings.where(F.col("slot").isin(*{t.slot for t in terms}) & F.col("term").isin(*[t.term for t in terms]))
    idfs = F.create_map(*(F.lit(x) for t in terms for x in (t.term, t.idf)))
    return hits.select("term", "doc_id", (idfs[F.col("term")] * weight(index.mean_length, F.col("tf"), F.col("dl"))).alias("part"))


def bm25(index: Index, terms: list[str]) -> DataFrame:
    return scored(index, known_terms(index, terms)).groupBy("doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def top_k(index: Index, terms: list[str], k: int, where: DataFrame | None = None, prune: bool = False) -> DataFrame:
    """The k best documents, ties by id; `where` holds the ids that may appear.

    With prune (and k > 0; else the plain scan passes through), the k-th best part of
    the term with the largest bound is a threshold.  Terms of the smallest bounds that
    together stay below it can't lift a document into the result by themselves:
    only documents of the other terms are scored, and the postings of the former are
    read for those alone.
    """
    known = known_terms(index, terms)
    within = lambda parts: parts if where is None else parts.join(where.select("doc_id").distinct(), "doc_id", "left_semi")
    skipped = 0
    if prune and k > 0 and len(known) > 1:
        seen = within(scored(index, known[-1:])).select("part").orderBy(F.desc("part")).limit(k).agg(F.count("*").alias("n"), F.min("part").alias("least")).first()
        reach = 0.0
        while seen["n"] == k and skipped < len(known) - 1 and (reach := reach + known[skipped].bound) < seen["least"] - 1e-6:
            skipped += 1
    parts = within(scored(index, known[skipped:]))
    best = parts.groupBy("doc_id").agg(F.sum("part").alias("score"))
    if skipped:
        # a document of the essential terms alone must still be able to reach the threshold with the rest
        rest = sum(t.bound for t in known[:skipped])
        able = best.where(F.col("score") + F.lit(rest) >= F.lit(seen["least"] - 1e-6))
        more = scored(index, known[:skipped]).join(able.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.sum("part").alias("more"))
        best = able.join(more, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    return best.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


class Threshold:
    """A bounded heap of scores: the threshold is 0 until k are seen, then the k-th best; only larger scores enter."""

    def __init__(self, k: int):
        self.k, self._heap = k, []

    def add(self, score: float) -> bool:
        if len(self._heap) < self.k:
            heapq.heappush(self._heap, score)
            return True
        if self.k and score > self._heap[0]:
            heapq.heapreplace(self._heap, score)
            return True
        return False

    @property
    def value(self) -> float:
        return self._heap[0] if self.k and len(self._heap) == self.k else 0.0

    def __len__(self) -> int:
        return len(self._heap)

    def reset(self) -> None:
        self._heap.clear()


@dataclass
class Pruned:
    """Documents (id, score, bound) by id, without those whose bound is below the threshold; counts what it skips."""

    docs: Iterable[tuple[int, float, float]]
    threshold: Threshold
    skipped: int = 0

    def __iter__(self) -> Iterator[tuple[int, float]]:
        for doc, score, bound in self.docs:
            if bound < self.threshold.value:
                self.skipped += 1
                continue
            self.threshold.add(score)
            yield doc, score

    def seek(self, target: int) -> int | None:
        """The first document from the target on that can compete."""
        return next((d for d, _, bound in self.docs if d >= target and bound >= self.threshold.value), None)


def wand_context(docs: Iterable[tuple[int, float, float]], enabled: bool, k: int) -> Iterable:
    """Documents behind a threshold of the k best; unchanged where pruning is off or k is 0."""
    return Pruned(docs, Threshold(k)) if enabled and k > 0 else docs
