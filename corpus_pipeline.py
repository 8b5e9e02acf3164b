"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  The driver of the stages is ``run``.  All
stages take null ids, texts and owners, repeated ids and rows, empty and very long
texts (one task holds a text whole) and empty tables; further columns are left out.
"""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mmspark.llm._spark import Steps, delete, join_spread, shared_folder, table
from mmspark.llm.langid import fit, held_out, predict
from mmspark.llm.line_dedup import line_dedup
from mmspark.llm.ngram_join import Settings, ngram_join
from mmspark.llm.packing import packed
from mmspark.llm.queries import tokenizer_file
from mmspark.llm.secrets import fingerprint, redact, secret_scan

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this posterior a text is in none of the known languages.
LEAST_SCORE = 0.4


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS[:-1], F.char_length("text").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay, and `lang` becomes the predicted one; texts without letters (null and empty ones too) go.

    Each row is judged by its own text, whatever its id.  One narrow pass.
    """
    model = fit(docs.where(~held_out()), tokenizer_file("piece_bpe_32k.model"))
    found = predict(docs, model, keep=("doc_id", "text", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in too many documents and too many distinct texts of a source go; a document left without text (so a null or empty one) goes.

    A null source is a source of its own; repeated rows count as documents, not as texts.
    """
    return _documents(line_dedup(docs.select(*COLUMNS), F.col("source"), count_copies=False).where("n_lines > n_removed"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows that repeat its id stay with it, and rows without an id all stay, as do null
    and empty texts, which are near nothing.
    """
    steps, docs = Steps(spark), docs.select(*COLUMNS)
    gone = steps.keep(ngram_join(docs, Settings()).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if steps.small(gone) else gone, "doc_id", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values that look live are replaced by a mark; widely copied examples stay.

    A null text stays null; rows that share an id are told apart by their texts; every row stays.
    """
    steps, docs = Steps(spark), docs.select(*COLUMNS)
    found = secret_scan(docs)
    live = F.array_sort(F.filter(F.concat("base", "added"), lambda x: F.array_contains("live", x["hash"])))
    # same id and text, same spans, as a text's values are live or not in the whole corpus
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    spans = steps.keep(found.select(F.xxhash64(name, "fingerprint").alias("row"), name, live.alias("spans")).where("size(spans) > 0").dropDuplicates(["row", "name"]))
    numbered = docs.select("*", F.xxhash64(name, fingerprint(F.col("text"))).alias("row"), name)
    marked = numbered.join(F.broadcast(spans), ["row", "name"], "left") if steps.small(spans) else join_spread(numbered, spans, "row", "text", "left", ["name"])
    return _documents(marked.withColumn("text", F.when(F.col("spans").isNotNull(), redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed token sequences; a null or empty text is one separator, a row each for repeated and null ids."""
    return packed(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("secrets", secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returns is written to the shared folder, read again by the next, and deleted once that is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            here = f"{folder}/{k}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if last:
                delete(spark, last)
            last = here
    return docs
