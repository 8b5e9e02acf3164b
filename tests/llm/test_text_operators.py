import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from mmspark.llm import queries as Q  # noqa: E402
from mmspark.llm.bpe import Codec, bpe_round_trip  # noqa: E402
from mmspark.llm import _text as T  # noqa: E402
from mmspark.llm.langid import Model, fit, held_out, predict, vocabulary, word_counts  # noqa: E402
from mmspark.llm.licenses import TEMPLATES, license_scan  # noqa: E402
from mmspark.llm.line_dedup import line_dedup  # noqa: E402
from mmspark.llm.ngram_join import Settings, ngram_join  # noqa: E402
from mmspark.llm.packing import pack, packed  # noqa: E402
from mmspark.llm.secrets import KINDS, redact, secret_scan  # noqa: E402
from mmspark.llm.substring_dedup import substring_dedup  # noqa: E402

BPE, PIECES = Q.tokenizer_file("word_bpe_49k.json"), Q.tokenizer_file("piece_bpe_32k.model")
#: Extra columns whose names the operators use inside.
EXTRA = "n long, chunk int, row long, owner string, hash long, key string, line string, id long, bucket long, t string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    """(doc_id, text, lang, source) rows with the extra columns."""
    return spark.createDataFrame([(i, t, g, s, None, *[None] * 10) for i, t, g, s in rows], SCHEMA).repartition(3)


def corpus(seed=7):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(250)]
    bases = [[rnd.choice(vocab) for _ in range(n)] for n in (30, 90, 300)]
    out = []
    for i in range(160):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, max(1, len(w) // 30))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append((3 * i, rnd.choice(["  ", " "]).join(w).capitalize() + rnd.choice(["", "\n"])))
    out += [(1000 + i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))) for i in range(120)]
    return out + [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "Ünï " * 30), (5004, "x" * 70_000)]


@pytest.mark.parametrize(("words", "percent", "rare"), [(3, 90, 32), (5, 80, 32), (2, 80, 3), (3, 90, 4), (3, 50, 6), (2, 20, 4), (1, 50, 8), (2, 100, 4)])
def test_ngram_join(spark, words, percent, rare):
    rows = corpus()
    found = ngram_join(table(spark, [(i, t, None, None) for i, t in rows]), Settings(words, percent, rare=rare, block_docs=20)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.join(rows, words, percent)


@pytest.mark.parametrize("words,percent,rare", [(3, 90, 4), (1, 50, 4)])
def test_ngram_join_counts_links(spark, words, percent, rare):
    rows = corpus()
    copies = [(9000 + i, t) for i, t in rows[:25]] + [(9900, None), (9901, " "), (9902, "w1"), (9903, "w1")]
    found = ngram_join(table(spark, [(i, t, None, None) for i, t in rows + copies]), Settings(words, percent, rare=rare, block_docs=20, count_links=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.join(rows + copies, words, percent)
    assert {r.doc_id: r.n_links for r in found} == brute.links(rows + copies, words, percent)


def test_ngram_join_counts_links_edges(spark):
    s = Settings(count_links=True)
    assert ngram_join(table(spark, []), s).collect() == []
    text = "one two three four five six seven"
    rows = table(spark, [(None, text, None, None), (4, text, None, None), (4, text, None, None), (5, text, None, None), (None, "alone in the whole wide table", None, None), (None, None, None, None)])
    found = sorted(map(tuple, ngram_join(rows, s).select("doc_id", "n_links").collect()), key=str)
    assert found == [(4, 1), (4, 1), (5, 1), (None, 0), (None, 0), (None, 1)]


def test_ngram_join_small_sets(spark):
    rows = [(i, f"a x{i} y{i}") for i in range(40)] + [(100 + i, f"b{i % 7}") for i in range(30)] + [(200, "a"), (201, "a b"), (202, "a a"), (203, "b a b a")]
    for words, percent in ((1, 20), (1, 50), (2, 34), (1, 90)):
        found = ngram_join(table(spark, [(i, t, None, None) for i, t in rows]), Settings(words, percent, rare=4, block_docs=9)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.join(rows, words, percent), (words, percent)
    for bad in ({"percent": 0}, {"percent": 101}, {"words": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def morse(n):
    """A two-letter sequence and its complement: equal under every polynomial modulo 2**64 with an odd base."""
    s = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return s, s.translate({97: 98, 98: 97})


def test_known_collisions(spark):
    one, two = morse(1024)
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}"), (4, one), (5, two)]
    found = {r.doc_id: r.n_removed for r in substring_dedup(table(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert found == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0}
    assert {r.doc_id: r.component_id for r in ngram_join(table(spark, [(i, t, None, None) for i, t in rows]), Settings(3, 90)).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_ngram_join_edges(spark):
    assert ngram_join(table(spark, []), Settings()).collect() == []
    text = "one two three four five six seven"
    rows = table(spark, [(None, text, None, None), (4, text, None, None), (4, text, None, None), (None, "alone in the whole wide table", None, None)])
    found = sorted(map(tuple, ngram_join(rows, Settings()).select("doc_id", "component_id").collect()), key=str)
    assert found == [(4, 4), (4, 4), (None, 4), (None, None)]


def test_substring_dedup(spark):
    rnd = random.Random(3)
    shared = [" ".join(f"p{rnd.randrange(99)}" for _ in range(n)) for n in (12, 13, 40)]
    rows = corpus() + [(2000 - i, f"{rnd.choice(shared)} u{i} {rnd.choice(shared)}\n v{i}") for i in range(60)] + [(3000, shared[2] + " " + shared[2])]
    for chunk in (1 << 10, 1 << 20):
        found = substring_dedup(table(spark, [(i, t, None, None) for i, t in rows]), chunk_bytes=chunk).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == brute.substrings(rows, 13)
        assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in found)


def test_substring_dedup_edges(spark):
    assert substring_dedup(table(spark, [])).collect() == []
    text = " ".join(f"a{i}" for i in range(20))
    found = substring_dedup(table(spark, [(7, text, None, None), (7, text, None, None), (None, text, None, None), (8, text + " b", None, None)])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in found) == [("7", 20, 0), ("7", 20, 0), ("8", 21, 20), ("None", 20, 0)]


def test_secret_scan(spark):
    live, common = "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "0123456789abcdef0123456789abcdef"
    rows = [(i, f'café {i} API_KEY: "{common}" and AKIA{"A1" * 9}X', None, f"s{i}") for i in range(5)]
    rows += [(10, f"token = {live}", None, "a"), (11, f"pasted T{live}Zz9 here {live.upper()}x", None, "a"), (12, f"see {live.upper()}x again", None, "a"), (13, "password=abc token=token : abcdefgh PASSWD='x.y=z-/'", None, "b")]
    rows += [(20, None, None, None), (21, "", None, None), (22, "ſecret=abcdefg secret=" + "k" * 50, None, None), (23, 'token="aaaaaa"token="bbbbbb" AKIAAKIA' + "Q" * 30, None, "c")]
    found = {r.doc_id: r for r in secret_scan(table(spark, rows)).collect()}
    for i, t, _, _ in rows:
        assert [(s.start, s.kind, s.end) for s in found[i].base] == brute.secrets(t), i
    assert found[0].n_examples == 2 and found[0].n_live == 0
    assert found[10].n_live == 1 and found[10].n_examples == 0
    assert [(s.start, s.end) for s in found[12].added] == [(4, 37)]
    assert secret_scan(table(spark, [])).collect() == []
    assert KINDS[:3] == ("assign", "access", "hex")


def test_secret_query_digest(spark, tmp_path):
    table(spark, [(1, "é token=abcdef " + "a" * 24, None, "s"), (2, None, None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in Q.op3_secret_scan(spark, str(tmp_path)).collect()}
    assert found[1].base_sha256 == hashlib.sha256(b"assign:2:14,hex:15:39").hexdigest() and found[1].n_hex == 1
    assert found[2].base_sha256 == hashlib.sha256(b"").hexdigest() and found[2].spans == ""


def test_redact(spark):
    spans = F.expr("array(struct(2 as start, 5 as end), struct(4 as start, 7 as end), struct(8 as start, 9 as end))")
    assert spark.range(1).select(redact(F.lit("éà23456789"), spans, "#").alias("x")).first().x == "éà#7#9"


def test_line_dedup(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "b", "c", None, "", "d"]), "\n".join(rnd.choice(["Home", " Home\t", "", f"body {i}", f"other {i % 7}"]) for _ in range(rnd.randint(0, 6)))) for i in range(80)]
    rows += [("a", None), ("a", ""), ("one", "only\npage"), ("two", "x\ny"), ("two", "x\nz"), ("six", "p\nq"), ("six", "p\nq"), ("six", "r"), ("six", "s")]
    df = spark.createDataFrame([(i, h, t, 0, 1, 2, 3, 4) for i, (h, t) in enumerate(rows)], "i long, host string, text string, n_lines long, __h int, site string, `a.b` int, common int").repartition(3)
    for limit in (8 << 20, -1):  # the second: the join of salted hosts
        monkeypatch.setattr("mmspark.llm._spark.SMALL_BYTES", limit)
        for repeats, copies in ((2, True), (1, True), (2, False)):
            found = line_dedup(df, F.col("host"), repeats=repeats, count_copies=copies)
            assert found.columns == ["i", "host", "text", "__h", "site", "a.b", "common", "n_lines", "n_removed"]
            got = {r.i: r for r in found.collect()}
            assert [got[i].text for i in range(len(rows))] == brute.lines(rows, 0.3, repeats, copies)
            assert all(r["a.b"] == 3 and r.common == 4 and r["__h"] == 1 and 0 <= r.n_removed <= r.n_lines for r in got.values())
    assert line_dedup(df.limit(0), F.col("host")).collect() == []


def test_license_scan(spark):
    body = "Some prose about nothing in particular. "
    rows = [(1, body + "\nReleased under the MIT License.\n" + body), (2, TEMPLATES[0][1]), (3, body * 40), (4, None), (5, ""), (6, body + "Licensed under CC BY-NC 4.0. " + body), (7, "x" * 50_000), (None, "licensed UNDER the apache license -- version 2.0"), (8, "# " + "\n# ".join(TEMPLATES[4][1].split(". ")))]
    found = {r.doc_id: [m.license for m in r.matches] for r in license_scan(table(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert found[1] == ["MIT"] and "MIT" in found[2] and found[3] == [] and found[4] == [] and found[5] == [] and found[6] == ["CC-BY-NC-4.0"] and found[7] == []
    assert found[None] == ["Apache-2.0"] and "BSD-2-Clause" in found[8]
    assert license_scan(table(spark, [])).collect() == []
    exact = license_scan(table(spark, [(2, TEMPLATES[3][1], None, None)])).first().matches
    assert max(m.dice for m in exact) == 1.0


def test_license_dice_by_brute_force(spark):
    """Every reported Dice is that of its words; every text that reaches the threshold as a whole is found."""
    rnd = random.Random(9)
    rows = []
    for k, (_, text) in enumerate(TEMPLATES):
        words = text.split()
        for j in range(4):  # some words replaced, from none to most
            rows.append((10 * k + j, " ".join(rnd.choice(["xx", "yy"]) if rnd.random() < 0.07 * j * j else w for w in words)))
    rows += [(9001, TEMPLATES[0][1] + " " + TEMPLATES[0][1]), (9002, None)]
    found = {r.doc_id: r.matches for r in license_scan(table(spark, [(i, t, None, None) for i, t in rows]), full_texts=()).collect()}
    names = {name: text for name, text in TEMPLATES}
    for i, t in rows:
        words = re.findall("[0-9a-z]+", (t or "").lower())
        for m in found[i]:
            assert m.dice >= 0.8 and abs(m.dice - max(brute.dice(" ".join(words[m.start : m.end]), x) for n, x in TEMPLATES if n == m.license)) < 1e-9
        best = max((brute.dice(t or "", x) for x in names.values()), default=0)
        assert best < 0.8 or max((m.dice for m in found[i]), default=0) >= best - 1e-9, i


def test_bpe_against_the_library(spark):
    c = Codec(BPE)
    rnd = random.Random(5)
    letters = "abcd the'sßéİΣ̱́ \u0085日本ᄀ가ﬁ½٣०\"!?-_<|>\t\n😀HK÷×"
    texts = [None, "", " \n", "<|endoftext|>", "a<|startoftext|>b 's it's can't'll X", "Hello, WORLD's (best)-café!"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200))) for _ in range(400)]
    texts += ["".join(rnd.choice("theandingresxqz") for _ in range(n)) for n in (255, 256, 257, 2000, 70_000)] + ["a" * 3000, "!?" * 2000, "é" * 2000]
    found = bpe_round_trip(table(spark, [(i, t, None, None) for i, t in enumerate(texts)]), BPE).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = c.tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == c.tok.decode(ids, skip_special_tokens=False)
    assert bpe_round_trip(table(spark, []), BPE).collect() == []


def test_packing(spark):
    c, rnd = Codec(BPE), random.Random(2)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.choice((0, 3, 200, 700, 1500, 9000)))), None, None) for i in range(60)]
    rows += [(100, None, None, None), (101, "", None, None), (7, "twice", None, None)]
    found = packed(table(spark, rows), BPE, bucket_bytes=100_000).collect()
    texts = {}
    for i, t, _, _ in rows:
        texts.setdefault(i, []).append([*c.tok.encode(t or "", add_special_tokens=False).ids, 2])
    sequences, by_doc = {}, {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length, total in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == total <= 4096 and total & (total - 1) == 0
    for i, versions in texts.items():
        if len(versions) > 1:
            continue
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(versions[0])
            assert r.ids_crc32 == zlib.crc32(np.array(versions[0][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(versions[0])
    sizes = {q: next(iter(x))[2] for q, x in sequences.items()}
    assert sum(sizes.values()) == sum(r.length for r in found)
    groups = {}
    for r in {(r.sequence_id, r.step_group, r.sequence_tokens) for r in found}:
        groups.setdefault((r[0] >> 32, r[1]), []).append(r[2])
    full = [sum(x) for x in groups.values()]
    assert max(full) <= 1 << 16 and sum(x == 1 << 16 for x in full) >= len(full) - len({k[0] for k in groups})  # all but a bucket's last are equal
    nameless = packed(table(spark, [(None, f"{i} beta" * 40, None, None) for i in range(200)]), BPE, bucket_bytes=2000).collect()
    assert len({r.sequence_id >> 32 for r in nameless}) > 4 and sum(r.start == 0 for r in nameless) == 200
    assert packed(table(spark, []), BPE).collect() == []
    assert pack([]) == []
    rnd = random.Random(6)
    lengths = [rnd.choice((1, 40, 400, 511, 513, 1500, 3000, 5000)) for _ in range(300)]
    done = pack(lengths)
    assert all(sum(p[2] for p in pieces) == size and size & (size - 1) == 0 for size, pieces in done) and sum(size for size, _ in done) == sum(lengths)
    assert sum(size == 4096 for size, _ in done) > 0.7 * sum(lengths) / 4096  # gaps of long windows are filled from shorter tiers


def test_language_id(spark):
    words = {"en": "the of and to in house water", "de": "der die und zu Haus Wasser über", "fr": "le la et à maison l'eau être"}
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(words[g].split()) for _ in range(20)), g, "s") for i, g in enumerate(list(words) * 30)]
    docs = table(spark, rows)
    model = fit(docs.where(~held_out()), PIECES)
    found = {r.doc_id: r for r in predict(docs, model).collect()}
    assert all(found[i].lang_pred == g and 0.5 < found[i].score <= 1 for i, _, g, _ in rows)
    odd = predict(table(spark, [(1, None, None, None), (2, "", None, None), (3, "123 !? ...", None, None), (None, "der die das", None, None), (5, "wasser" * 20_000, None, None), (6, "日本", None, None)]), model).collect()
    by = {r.doc_id: r for r in odd}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0 and by[None].lang_pred == "de" and by[5].lang_pred == "de" and by[6].lang_pred != "und"
    assert predict(table(spark, []), model).collect() == []
    nothing = fit(docs.limit(0), PIECES)
    assert nothing.languages == [] and {r.lang_pred for r in predict(docs, nothing).collect()} == {"und"}
    number = {h: i for i, h in enumerate(model.hashes.tolist())}
    pieces = vocabulary(PIECES)
    marks = [np.array([ord(c) for c in p], np.uint64) for p in pieces]
    place = {p: number[int(T.mix(np.sum(m * T.powers(T._BASE, len(m)), dtype=np.uint64, keepdims=True) + np.uint64(len(p)))[0])] for p, m in zip(pieces, marks, strict=True)}
    for word in ("haus", "über", "the", "maisonж", "q"):  # the sum over all segmentations, one by one
        want = np.zeros(len(model.languages))
        for cut in brute.segmentations("▁" + word):
            rows_ = [place.get(p, len(model.hashes) if len(p) == 1 else None) for p in cut]
            if None not in rows_:
                want += np.prod(model.probs[rows_], axis=0)
        assert np.allclose(model.score([word])[0], np.log(want)) and np.allclose(model.long(word), np.log(want))
    assert isinstance(model, Model)


def test_language_fit_is_bounded(spark, monkeypatch):
    rows = [(None, f"the house of number {i}", "en", "s") for i in range(900)] + [(7, f"das haus nummer {i}", "de", "s") for i in range(900)]
    read = []
    monkeypatch.setattr("mmspark.llm.langid.word_counts", lambda docs: read.append(docs.count()) or word_counts(docs))
    fit(table(spark, rows), PIECES, max_docs=50)
    assert 20 < read[0] < 250
    long = fit(table(spark, [(1, "日本語" * 40, "ja", "s"), (2, "der hund " * 9, "de", "s")]), PIECES)
    assert predict(table(spark, [(3, "日本語" * 30, None, None)]), long).first().lang_pred == "ja"
    tied = fit(table(spark, [(1, "abc abd", "x", "s"), (2, "abc abd", "a", "s")]), PIECES)
    assert predict(table(spark, [(3, "abc", None, None)]), tied).first().lang_pred == "a"


def test_held_out_accuracy(spark):
    found = Q.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
