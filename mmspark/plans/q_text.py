"""Registered masking, similarity and search queries, each with its DuckDB SQL."""

from pyspark.sql import functions as F

from mmspark.functions import masking as M
from mmspark.functions import similarity as S
from mmspark.functions.hashing import MERSENNE, fnv1a64, permutation_seeds, permute, reduce_mersenne
from mmspark.functions.text import AnalyzerConfig, minhash_tokens, tokenize
from mmspark.operators import search
from mmspark.plans.q_graph import duck_fnv32, table

QUERIES: dict = {}
SQL: dict = {}
K = 16
TERMS = ["the", "and", "thing", "eau"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _md5(c):
    return F.md5(c.cast("binary"))


@query("SELECT doc_id, md5(array_to_string(list_transform(range(0, strlen(text)), lambda i: CASE WHEN substr(hex(encode(text)), 2 * i + 1, 2) = '20' THEN ' ' ELSE 'x' END), '')) AS masked FROM documents")
def mask_xify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _md5(M.xify_front(F.col("text"))).alias("masked"))


def _letters(shift: int) -> str:
    return " || ".join(f"chr((65 + (h >> {shift}) // {26**i} % 26)::INTEGER)" for i in range(4))


@query(f"WITH k AS (SELECT c_custkey, {duck_fnv32('c_name')} AS h FROM customer) SELECT c_custkey, {_letters(0)} || '.' || {_letters(8)} || '@' || {_letters(16)} || '.invalid' AS masked FROM k")
def mask_email(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", M.email(F.col("c_name")).alias("masked"))


_CARD = "array_to_string(list_transform(string_split(v, ''), lambda ch, i: CASE WHEN ch BETWEEN '0' AND '9' AND length(regexp_replace(substr(v, i + 1), '[^0-9]', '', 'g')) >= 4 THEN 'x' ELSE ch END), '')"


@query(f"WITH k AS (SELECT c_custkey, c_name || ' ' || c_custkey || '-' || (c_custkey * 7919) AS v FROM customer) SELECT c_custkey, {_CARD} AS masked FROM k")
def mask_card(spark, sf_dir):
    v = F.concat("c_name", F.lit(" "), F.col("c_custkey").cast("string"), F.lit("-"), (F.col("c_custkey") * 7919).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", M.credit_card(v).alias("masked"))


@query(f"WITH k AS (SELECT c_custkey, '+' || (c_custkey % 97) || ' (555) ' || (c_custkey * 104729) || ' ext.' || c_custkey AS v FROM customer) SELECT c_custkey, regexp_replace({_CARD}, '[^0-9x() .-]', 'x', 'g') AS masked FROM k")
def mask_phone(spark, sf_dir):
    v = F.concat(F.lit("+"), (F.col("c_custkey") % 97).cast("string"), F.lit(" (555) "), (F.col("c_custkey") * 104729).cast("string"), F.lit(" ext."), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", M.phone(v).alias("masked"))


CONFIG = '{"collections": {"customer": {"rules": [{"path": "c_name", "type": "xifyFront"}, {"path": "c_mktsegment", "type": "xifyFront", "roles": ["viewer"]}, {"path": "c_custkey_text", "type": "creditCard", "roles": ["admin"]}, {"path": "c_name", "type": "nosuch"}]}}}'


@query("SELECT c_custkey, regexp_replace(c_name, '[^ ]', 'x', 'g') AS c_name, regexp_replace(c_mktsegment, '[^ ]', 'x', 'g') AS c_mktsegment, c_custkey::VARCHAR AS c_custkey_text FROM customer")
def mask_apply_role(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_custkey").cast("string").alias("c_custkey_text"))
    return M.apply_masks(c, M.MaskingConfig.from_json(CONFIG), "customer", "viewer")


_WS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_WS})::BIGINT AS tokens, len(list_distinct({_WS}))::BIGINT AS distinct_tokens FROM documents")
def tokenize_ws(spark, sf_dir):
    t = tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("distinct_tokens"))


@query("SELECT doc_id, len(list_filter(string_split(text, '. '), lambda x: x <> ''))::BIGINT AS parts, md5(array_to_string(list_filter(string_split(text, '. '), lambda x: x <> ''), '|')) AS digest FROM documents")
def tokenize_delim(spark, sf_dir):
    t = tokenize(F.col("text"), ". ")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("parts"), _md5(F.array_join(t, "|")).alias("digest"))


def _signature_sql(source: str, key: str, k: int = K) -> str:
    """CTEs ending in sig(key, slot, v): the signatures of the texts of a table."""
    seeds = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(permutation_seeds(k)))
    bytes_ = "list_transform(range(0, strlen(tok)), lambda i: ('0x' || substr(hex(encode(tok)), 2 * i + 1, 2))::HUGEINT)"
    fnv = f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {bytes_}), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    return f"""tk AS (SELECT {key}, unnest(list_distinct({_WS})) AS tok FROM {source}), ut AS (SELECT tok, {fnv} % {MERSENNE}::HUGEINT AS x FROM (SELECT DISTINCT tok FROM tk)),
sd(slot, a, b) AS (VALUES {seeds}), sig AS (SELECT {key}, slot, min((a * x + b) % {MERSENNE}::HUGEINT)::BIGINT AS v FROM tk JOIN ut USING (tok) CROSS JOIN sd GROUP BY ALL)"""


@query(f"WITH {_signature_sql('documents', 'doc_id')}, al AS (SELECT doc_id, slot FROM documents CROSS JOIN sd) SELECT al.doc_id, array_to_string(list(coalesce(v, -1) ORDER BY al.slot), ',') AS signature FROM al LEFT JOIN sig ON al.doc_id = sig.doc_id AND al.slot = sig.slot GROUP BY al.doc_id")
def minhash_sig16(spark, sf_dir):
    s = S.minhash(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", K)
    return s.select("doc_id", F.array_join(F.transform("signature", lambda v: v.cast("string")), ",").alias("signature"))


@query(f"WITH {_signature_sql('documents', 'doc_id', 8)} SELECT doc_id, slot::VARCHAR || ':' || v AS token FROM sig")
def minhash_tokens8(spark, sf_dir):
    return minhash_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", AnalyzerConfig(8)).select("doc_id", F.explode("tokens").alias("token"))


@query(f"WITH {_signature_sql('benchmark', 'item_id', 8)} SELECT item_id, slot, v AS value FROM sig")
def minhash_native8(spark, sf_dir):
    """The signature in column expressions only: hash each distinct token once, then the least of each permutation."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("tok"))
    x = t.select("tok").distinct().select("tok", reduce_mersenne(fnv1a64(F.col("tok"))).alias("x"))
    seeds = F.array(*(F.struct(F.lit(i).alias("slot"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(permutation_seeds(8))))
    rows = t.join(x, "tok").select("item_id", "x", F.explode(seeds).alias("s"))
    return rows.groupBy("item_id", "s.slot").agg(F.min(permute(F.col("x"), F.col("s.a"), F.col("s.b"))).alias("value"))


_PAIRS = "p AS (SELECT doc_id, item_id FROM documents CROSS JOIN benchmark)"


def _match_sql(tail: str) -> str:
    a = _signature_sql("documents", "doc_id")
    b = a.replace("doc_id", "item_id").replace("documents", "benchmark")
    for n in ("tk", "ut", "sd", "sig"):
        b = b.replace(f"{n} AS (", f"{n}2 AS (").replace(f"{n}(slot", f"{n}2(slot").replace(f"FROM {n})", f"FROM {n}2)").replace(f"FROM {n} ", f"FROM {n}2 ").replace(f"JOIN {n} ", f"JOIN {n}2 ")
    return f"WITH {a}, {b}, {_PAIRS}, m AS (SELECT p.doc_id, p.item_id, sum(CASE WHEN s1.v = s2.v THEN 1 ELSE 0 END) / {K}.0 AS e FROM p JOIN sig s1 ON s1.doc_id = p.doc_id JOIN sig2 s2 ON s2.item_id = p.item_id AND s1.slot = s2.slot GROUP BY ALL) {tail}"


def _items_signed(spark, sf_dir):
    """The estimates of every document with every item of the benchmark, a stated query set that is met in blocks."""
    d = S.minhash(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", K, "s1").select("doc_id", "s1").where(F.element_at("s1", 1) != -1)
    b = S.minhash(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", K, "s2").select("item_id", "s2").where(F.element_at("s2", 1) != -1)
    same = sum((F.col("s1")[i] == F.col("s2")[i]).cast("int") for i in range(K))
    return S.with_items(d, b, "item_id").select("doc_id", "item_id", (same / F.lit(K)).alias("estimate"))


@query(_match_sql("SELECT doc_id, item_id, e::DOUBLE AS estimate FROM m"))
def minhash_estimate(spark, sf_dir):
    return _items_signed(spark, sf_dir)


@query(_match_sql("SELECT e >= 0.125 AS matched, count(*) AS pairs FROM m GROUP BY ALL"))
def minhash_match(spark, sf_dir):
    return _items_signed(spark, sf_dir).groupBy((F.col("estimate") >= 0.125).alias("matched")).agg(F.count("*").alias("pairs"))


@query(f"WITH k AS (SELECT doc_id, item_id, list_distinct({_WS.replace('text', 'd.text')}) AS a, list_distinct({_WS.replace('text', 'b.text')}) AS b FROM documents d CROSS JOIN benchmark b) SELECT doc_id, item_id, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS jaccard FROM k")
def jaccard_exact(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", tokenize(F.col("text")).alias("t"))
    docs, found = table(spark, sf_dir, "documents").select("doc_id", "text"), None
    for block in S.item_blocks(items, "item_id"):
        pairs = S.jaccard_with_items(docs, [(r.item_id, r.t) for r in block.collect()])
        found = pairs if found is None else found.unionByName(pairs)
    return found.select("doc_id", "item_id", F.round("jaccard", 9).alias("jaccard"))


_CLASSES = f"WITH {_signature_sql('documents', 'doc_id')}, g AS (SELECT doc_id, string_agg(v::VARCHAR, ',' ORDER BY slot) AS s FROM sig GROUP BY doc_id), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM g)"


@query(f"{_CLASSES}, r AS (SELECT sig.* FROM sig JOIN c USING (doc_id) WHERE doc_id = class_id) SELECT x.doc_id AS id1, y.doc_id AS id2, count(*) / {K}.0::DOUBLE AS similarity FROM r x JOIN r y ON x.slot = y.slot AND x.v = y.v AND x.doc_id < y.doc_id GROUP BY ALL HAVING count(*) >= 0.75 * {K}")
def similarity_join(spark, sf_dir):
    s = S.minhash(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", K)
    return S.similarity_join(s, "doc_id", "signature", 0.75, K)


@query(f"{_CLASSES}, e AS (SELECT min(doc_id) AS none FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c)) SELECT documents.doc_id, coalesce(class_id, none) AS class_id FROM documents LEFT JOIN c USING (doc_id) CROSS JOIN e WHERE text IS NOT NULL")
def similarity_classes(spark, sf_dir):
    s = S.minhash(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"), "text", K)
    return S.similarity_classes(s, "doc_id", "signature")


def _bm25_sql(where: str = "true") -> str:
    terms = ", ".join(f"'{t}'" for t in TERMS)
    low = _WS.replace("text", "lower(coalesce(text, ''))")
    return f"""WITH d AS (SELECT doc_id, lang, {low} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d),
tf AS (SELECT doc_id, lang, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d CROSS JOIN (SELECT unnest([{terms}]) AS term)), h AS (SELECT * FROM tf WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 6) AS score FROM h JOIN f USING (term) CROSS JOIN n WHERE {where} GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10"""


def _index(spark, sf_dir):
    return search.build_index(table(spark, sf_dir, "documents"), terms=TERMS)


@query(_bm25_sql())
def bm25_topk(spark, sf_dir):
    return search.top_k(_index(spark, sf_dir), TERMS, 10)


@query(_bm25_sql("lang = 'fr'"))
def bm25_filtered_topk(spark, sf_dir):
    return search.top_k(_index(spark, sf_dir), TERMS, 10, where=table(spark, sf_dir, "documents").where("lang = 'fr'"))


@query(_bm25_sql())
def topk_pruned_equals_full(spark, sf_dir):
    return search.top_k(_index(spark, sf_dir), TERMS, 10, prune=True)
