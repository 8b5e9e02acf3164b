import pytest

pytest.importorskip("public_tokenizers")

from mmspark.llm.licenses import FULL_TEXTS, TEMPLATES, license_scan  # noqa: E402


def broken(text):
    """The text in paragraphs of two sentences and lines of eight words."""
    parts = text.replace(". ", ".\n").split("\n")
    return "\n\n".join("\n".join(" ".join(w[k : k + 8]) for k in range(0, len(w), 8)) for i in range(0, len(parts), 2) if (w := " ".join(parts[i : i + 2]).split()))


def test_every_template_inside_a_long_document(spark):
    prose = "\n\n".join(f"Chapter {i} tells of rivers{i} and hills{i}.\nNothing{i} else happens there{i} for long{i}." for i in range(300))
    all_texts = [(name, broken(text)) for name, text in TEMPLATES] + list(FULL_TEXTS)
    rows = [(i, f"{prose}\n\n{text}\n\n{prose}") for i, (_, text) in enumerate(all_texts)] + [(1000, prose), (1001, None)]
    twice = all_texts[0][1]
    rows.append((1002, f"{twice}\n\n{prose}\n\n{twice}"))
    found = {r.doc_id: r.matches for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, (name, text) in enumerate(all_texts):
        best = max(found[i], key=lambda m: m.end - m.start, default=None)
        assert best is not None and best.license == name and best.dice > 0.95, (i, name, found[i])
    assert found[1000] == [] and found[1001] == []
    assert [m.license for m in found[1002] if m.dice > 0.95] == ["MIT", "MIT"]
