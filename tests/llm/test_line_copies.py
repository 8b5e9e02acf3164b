import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def test_copies_do_not_make_boilerplate(spark):
    """Copies are over 0.3 of their source; one representative reaches the end, and a real common line still goes."""
    copy = "A clean page of its own.\nIts second line."
    rows = [(i, copy, "en", "a", 0) for i in range(6)] + [(10 + i, f"Menu\nbody {i} stands only here", "en", "a", 0) for i in range(8)]
    rows += [(30 + i, t, "en", "b", 0) for i, t in enumerate([copy, copy, "one", "two", "three", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = corpus_pipeline.lines(spark, docs, "")
    found = {r.doc_id: r.text for r in left.collect()}
    assert found == {**{i: copy for i in (*range(6), 30, 31)}, **{10 + i: f"body {i} stands only here" for i in range(8)}, 32: "one", 33: "two", 34: "three"}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, left, "").where("doc_id < 10").collect()} == {0}
