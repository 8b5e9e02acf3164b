import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from mmspark.llm.secrets import secret_scan  # noqa: E402


def test_a_key_in_many_documents_of_one_owner_is_live(spark):
    key, bare, example = "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "Zq8" * 9, "0123456789abcdef0123456789abcdef"
    rows = [(i, f"n{i} token={key} and {bare} here", "en", "big", 0) for i in range(150)]
    rows += [(1000 + i, f"n{i} token={example}", "en", f"s{i % 3}", 0) for i in range(150)]
    rows += [(2000 + i, f"n{i} token={'ab12' * 8}", "en", None, 0) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in secret_scan(docs).collect()}
    assert all((found[i].n_live, found[i].n_examples, len(found[i].added)) == (1, 0, 1) for i in range(150))
    assert all((found[i].n_live, found[i].n_examples) == (0, 1) for i in [*range(1000, 1150), *range(2000, 2150)])
    texts = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    assert all(texts[i] == f"n{i} [SECRET] and [SECRET] here" for i in range(150))
    assert all("[SECRET]" not in texts[i] for i in range(1000, 1150))
