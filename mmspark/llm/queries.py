"""The ten queries over whole tables, with production parameters, and their SQL."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mmspark.llm._spark import table
from mmspark.llm.bpe import bpe_round_trip
from mmspark.llm.embedding_dedup import embedding_dedup
from mmspark.llm.langid import fit, held_out, predict
from mmspark.llm.licenses import license_scan
from mmspark.llm.line_dedup import host, line_dedup, visible_lines
from mmspark.llm.ngram_join import Settings, ngram_join
from mmspark.llm.packing import packed
from mmspark.llm.secrets import listed, secret_scan
from mmspark.llm.substring_dedup import substring_dedup
from mmspark.llm.topk import top_k


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file: under $MMSPARK_TOKENIZERS, or where the installed package has it."""
    if folder := os.environ.get("MMSPARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    best = F.reduce("matches", F.lit(0.0), lambda a, x: F.greatest(a, x["dice"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["license"]))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.round(best, 6).alias("best_dice"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), Settings(words=3, percent=90, count_links=True))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_examples")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()), tokenizer_file("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", host().alias("host"), visible_lines().alias("text"))
    return line_dedup(pages, F.col("host")).select("page_id", "host", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_ngram_join, op3_secret_scan, op4_packing, op5_embedding_dedup, op6_substring_dedup, op7_language_id, op8_top_k, op9_line_dedup, op10_bpe_round_trip)}

#: Ends in reach(id, r): every id r that id reaches by pairs p(a, b), itself included; ids come from `ids`.
_REACH = "reach(id, r) AS (SELECT id, id FROM ids UNION SELECT reach.id, p.b FROM reach JOIN p ON reach.r = p.a)"
_ANY_CASE = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_VALUE = "[A-Za-z0-9+/_.=-]+"
_KINDS = (
    ("assign", 0, f"""({_ANY_CASE})["'']?\\x20*[:=]\\x20*["'']?({_VALUE})""", 2, 6, "true"),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 20, "true"),
    ("hex", 2, "[0-9a-f]+", 0, 24, "true"),
    ("bare", 3, "[A-Za-z0-9+/_=-]+", 0, 20, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')"),
)


def _found_sql(name: str, number: int, pattern: str, group: int, least: int, also: str) -> str:
    """The spans of a kind: matches and the pieces between them alternate."""
    return f"""SELECT doc_id, source, '{name}' AS kind, {number} AS k, b AS s, b + length(m) AS e, v FROM (SELECT doc_id, source, ms[i] AS m, vs[i] AS v,
  list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS b
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, source, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs, regexp_split_to_array(text, '{pattern}') AS ps FROM d))) WHERE length(v) >= {least} AND {also}"""


ORACLE_SQL = {
    "op2_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws, ' ') AS whole, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS gs FROM w),
g AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
ids AS (SELECT doc_id AS id FROM s), {_REACH}, c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT doc_id, len(gs)::BIGINT AS n_shingles, CASE WHEN len(gs) > 0 THEN min(doc_id) OVER (PARTITION BY whole) ELSE doc_id END AS class_id, component_id, coalesce(n.n, 0)::BIGINT AS n_links FROM s JOIN c ON c.id = s.doc_id LEFT JOIN n ON n.a = s.doc_id""",
    "op3_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_found_sql(*k) for k in _KINDS)}),
b AS (SELECT * FROM f WHERE kind <> 'bare'),
o AS (SELECT * FROM f WHERE kind = 'bare' AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = f.doc_id AND b.s < f.e AND f.s < b.e)),
live AS (SELECT v FROM (SELECT * FROM b UNION ALL SELECT * FROM o) GROUP BY v HAVING count(DISTINCT source) <= 2 AND count(DISTINCT doc_id) FILTER (source = '') <= 100),
n AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS base,
  count(DISTINCT v) FILTER (v IN (SELECT v FROM live)) AS n_live, count(DISTINCT v) FILTER (v NOT IN (SELECT v FROM live)) AS n_examples FROM b GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM o WHERE v IN (SELECT v FROM live)) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id)""",
    "op5_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings), {_REACH}, c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM g),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM k),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS r FROM m WHERE least < doc_id GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(r), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(coalesce(r, []), x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)""",
    "op8_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_line_dedup": r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|[\r\n\t]', ' ', 'g'),
    '(?i)</?(?:html|head|body|title|nav|ul|ol|li|div|article|section|header|footer|main|aside|h[1-6]|p|br|hr|table|tr|td|th|pre|blockquote)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages),
l AS (SELECT page_id, host, string_split(text, chr(10)) AS ls FROM p),
d AS (SELECT page_id, host, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line FROM l),
t AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
c AS (SELECT host, line FROM d JOIN t USING (host) GROUP BY host, line, pages HAVING count(*) >= 2 AND count(*) > 0.3 * pages),
h AS (SELECT host, list(line) AS common FROM c GROUP BY host),
k AS (SELECT page_id, l.host, ls, list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' OR NOT list_contains(coalesce(common, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept FROM l LEFT JOIN h ON l.host = h.host)
SELECT page_id, host, len(list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''))::BIGINT AS n_lines, (len(ls) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k""",
}
