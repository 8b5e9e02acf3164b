"""MinHash signatures and Jaccard similarity."""

import re
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mmspark.functions.hashing import MERSENNE, permutation_seeds
from mmspark.sources.folders import stored

DEFAULT_K, MAX_K = 128, 4096
#: A slot of an empty set: all 64 bits set.
EMPTY = -1
_SPACE = re.compile("[^ \t\n\x0b\x0c\r]+")


def _hash_tokens(tokens: list[bytes]) -> np.ndarray:
    """FNV-1a 64 of each token, reduced modulo 2**61 - 1; a step for each byte position."""
    raw = tokens
    size = np.array([len(b) for b in raw])
    order = np.argsort(size, kind="stable")
    data = np.frombuffer(b"".join(raw), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    for p in range(int(size.max(initial=0))):
        live = order[np.searchsorted(size[order], p, "right") :]
        h[live] = (h[live] ^ data[start[live] + p]) * np.uint64(0x100000001B3)
    x = (h & np.uint64(MERSENNE)) + (h >> np.uint64(61))
    return x % np.uint64(MERSENNE)


def _permuted(x: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """(a * x + b) modulo 2**61 - 1."""
    p, m31, m30 = np.uint64(MERSENNE), np.uint64(2**31 - 1), np.uint64(2**30 - 1)
    x1, x0 = x >> np.uint64(31), x & m31
    a1, a0 = a >> np.uint64(31), a & m31
    mid = a1 * x0 + a0 * x1
    return ((np.uint64(2) * a1 * x1 + (mid >> np.uint64(30)) + ((mid & m30) << np.uint64(31)) + a0 * x0) % p + b) % p


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the tokens between white space of all texts, offsets of each text in them); those six blanks are ASCII, so bytes will do."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    solid = ~_BLANK[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = off[off < len(raw)]
    begin[edges] = solid[edges]
    starts = np.flatnonzero(begin)
    place = np.cumsum(solid)
    cuts = np.append(place[starts] - 1, place[-1] if len(place) else 0).astype(np.int64)
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw[solid])])
    return tokens, np.searchsorted(starts, off)


def signatures(column: pa.Array, seeds: np.ndarray) -> pa.Array:
    """The signature of each text or token array: every distinct token of the batch is hashed and permuted once, then the least of each row is taken."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten()
        known = np.concatenate([[0], np.cumsum(~np.asarray(flat.is_null()))])
        off = known[np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)]
        tokens = flat.drop_null().cast(pa.large_string()).cast(pa.large_binary())
    else:
        tokens, off = _tokens(column)
    out = np.full((len(column), len(seeds)), EMPTY, np.int64)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        coded = tokens.dictionary_encode()
        codes, x = coded.indices.to_numpy(), _hash_tokens(coded.dictionary.to_pylist())
        for i, (a, b) in enumerate(seeds):
            out[full, i] = np.minimum.reduceat(_permuted(x, a, b)[codes], off[:-1][full]).astype(np.int64)
    ends = np.arange(len(column) + 1, dtype=np.int32) * len(seeds)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=column.is_null())


def minhash(df: DataFrame, tokens: str, k: int = DEFAULT_K, output: str = "signature") -> DataFrame:
    """Add the signature of a column of token arrays (or of strings, cut at white space); null for null, all EMPTY for no tokens.

    One narrow Arrow pass: no shuffle, no explosion into k rows a token.
    """
    if not 0 < k <= MAX_K:
        return df.withColumn(output, F.lit(None).cast("array<long>"))
    return df.withColumn(output, _signer(k)(F.col(tokens)))


def _signer(k: int):
    seeds = np.array(permutation_seeds(k), np.uint64)
    return F.arrow_udf(lambda column: signatures(column, seeds), "array<long>")


def register(spark) -> None:
    """The names of the SQL functions: MINHASH(tokens), MINHASH_MATCH(a, b, threshold), JACCARD(a, b)."""
    spark.udf.register("MINHASH", _signer(DEFAULT_K))
    for name, parameters, result, body in (
        ("JACCARD", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 1D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
        ("MINHASH_MATCH", "a ARRAY<BIGINT>, b ARRAY<BIGINT>, threshold DOUBLE", "BOOLEAN", "CASE WHEN threshold BETWEEN 0 AND 1 THEN CASE WHEN size(a) = size(b) AND size(a) > 0 THEN size(filter(zip_with(a, b, (x, y) -> x = y), z -> z)) / size(a) ELSE 0D END >= threshold END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def estimate_jaccard(a: Column, b: Column) -> Column:
    """Equal slots over all slots; 0 for unequal or no length."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))


def minhash_match(a: Column, b: Column, threshold: float) -> Column:
    """Whether the estimate reaches the threshold; null for a threshold outside [0, 1]."""
    return estimate_jaccard(a, b) >= threshold if 0 <= threshold <= 1 else F.lit(None).cast("boolean")


def jaccard(a: Column, b: Column) -> Column:
    """Exact set similarity; 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


ITEMS = 4096


def item_blocks(items: DataFrame, key: str, size: int = ITEMS) -> list[DataFrame]:
    """A query set in blocks of about `size` rows by a hash of the key, at least one."""
    m = max(1, -(-items.count() // size))
    return [items.where(F.pmod(F.xxhash64(key), F.lit(m)) == i) for i in range(m)] if m > 1 else [items]


def with_items(docs: DataFrame, items: DataFrame, key: str, size: int = ITEMS) -> DataFrame:
    """Every document with every row of a query set: one block of items goes to all tasks, more meet copies of the documents by block."""
    m = max(1, -(-items.count() // size))
    if m == 1:
        return docs.crossJoin(F.broadcast(items))
    blocks = docs.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return blocks.join(items.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(m)).cast("int")), "__block").drop("__block")


def jaccard_with_items(docs: DataFrame, items: list[tuple], rows: int = 1 << 16) -> DataFrame:
    """(doc_id, item_id, jaccard) of every document of (doc_id, text) with every item of (id, tokens): null for a null text or item, 1 for two empty sets.

    The items are a query set that each worker holds; a document's tokens are
    looked up once and summed for all items, and pairs leave in batches of about
    `rows`.
    """
    sets = [None if t is None else set(t) for _, t in items]
    word = {t: i for i, t in enumerate(sorted(set().union(*(s or () for s in sets))))}
    entries = np.array([(word[t], j) for j, s in enumerate(sets) for t in s or ()], np.int64).reshape(-1, 2)
    entries = entries[np.argsort(entries[:, 0], kind="stable")]
    begin, holder = np.searchsorted(entries[:, 0], np.arange(len(word) + 1)).tolist(), entries[:, 1]
    size, missing = np.array([len(s or ()) for s in sets], np.int64), np.array([s is None for s in sets], bool)
    ids = pa.array([i for i, _ in items], pa.int64())
    block = max(1, rows // max(1, len(items)))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows if items else 0, block):
                batch = whole.slice(at, block)
                values, empty = np.zeros((batch.num_rows, len(items))), np.zeros((batch.num_rows, len(items)), bool)
                for k, text in enumerate(batch.column(1).to_pylist()):
                    if text is None:
                        empty[k] = True
                        continue
                    own = set(_SPACE.findall(text))
                    found = [holder[begin[w] : begin[w + 1]] for w in map(word.get, own) if w is not None]
                    shared = np.bincount(np.concatenate(found), minlength=len(items)) if found else np.zeros(len(items), np.int64)
                    union = len(own) + size - shared
                    values[k] = np.where(union == 0, 1.0, shared / np.maximum(union, 1))
                    empty[k] = missing
                pair = [batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(items)))), pa.concat_arrays([ids] * batch.num_rows), pa.array(values.ravel(), mask=empty.ravel())]
                yield pa.RecordBatch.from_arrays(pair, ["doc_id", "item_id", "jaccard"])

    return docs.select(docs.columns[0], docs.columns[1]).mapInArrow(run, "doc_id long, item_id long, jaccard double")


def similarity_classes(df: DataFrame, key: str, signature: str) -> DataFrame:
    """(key, class_id): the smallest key with the same signature; null for a null signature.  Copies are a class, not pairs."""
    least = df.where(F.col(signature).isNotNull()).groupBy(F.col(signature).alias("__s")).agg(F.min(key).alias("class_id"))
    return df.select(key, signature).join(least, F.col(signature) == F.col("__s"), "left").select(key, "class_id")


#: Slots that a key of the join should have, and the most keys of a class for that.
KEY_SLOTS, KEYS = 5, 64


def slot_keys(k: int, need: int) -> tuple[list[list[int]], list[list[int]]]:
    """([first slot, slots] of the groups that k slots are cut into, the sets of groups that make a key each).

    Signatures that share `need` slots differ in k - need groups at most, so
    with g groups more than that they share g whole groups, hence a key.  One slot
    alone is often the hash of a word that a large part of all texts has.
    """
    miss = max(0, k - need)
    g = next((g for g in range(1, k - miss) if k * g >= KEY_SLOTS * (miss + g) or comb(miss + g + 1, g + 1) > KEYS), k - miss)
    cuts = [k * i // (miss + g) for i in range(miss + g + 1)]
    return [[a + 1, b - a] for a, b in pairwise(cuts)], [list(c) for c in combinations(range(miss + g), g)]


def candidates(classes: DataFrame, signature: str, k: int, need: int) -> DataFrame:
    """(id1, id2), each once: the pairs of (rep, signature) that share a key, so all that share `need` slots."""
    groups, sets = slot_keys(k, need)
    parts = classes.select("rep", F.transform(F.lit(groups), lambda c: F.xxhash64(c[0], F.slice(signature, c[0], c[1]))).alias("parts"))
    keys = parts.select("rep", F.explode(F.transform(F.lit(sets), lambda c: F.xxhash64(F.transform(c, lambda i: F.col("parts")[i])))).alias("key"))
    a, b = (keys.select(F.col("rep").alias(f"id{x}"), "key") for x in "12")
    return a.join(b.hint("merge"), "key").where(F.col("id1") < F.col("id2")).select("id1", "id2").distinct()


def similarity_join(df: DataFrame, key: str, signature: str, threshold: float, k: int) -> DataFrame:
    """(id1, id2, similarity) of the pairs of classes whose estimate reaches the threshold (> 0), id1 < id2.

    A class is named by its smallest key (see similarity_classes).  A pair shares
    round(threshold * k) slots or more, so it shares a key (see slot_keys); the
    estimate of each pair with a common key decides.  Empty signatures are one
    class and in no pair.  Signatures and classes are written once.
    """
    need = max(1, int(np.ceil(threshold * k - 1e-9)))
    signed = stored(df.select(key, signature), "signatures")
    classes = stored(signed.where(F.col(signature).isNotNull() & (F.element_at(signature, 1) != EMPTY)).groupBy(signature).agg(F.min(key).alias("rep")), "classes")
    one, two = (classes.select(F.col("rep").alias(f"id{x}"), F.col(signature).alias(f"s{x}")).hint("merge") for x in "12")
    pairs = candidates(classes, signature, k, need).join(one, "id1").join(two, "id2")
    return pairs.select("id1", "id2", estimate_jaccard(F.col("s1"), F.col("s2")).alias("similarity")).where(F.col("similarity") >= threshold)
