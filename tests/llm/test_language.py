import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusloom.llm import language as L

DATA = "/root/testdata/sf0.001"
EN = "The summary of the report was written by the team before the release and then it was read by nobody."
FR = "Le résumé du rapport a été écrit par l'équipe avant la livraison et puis personne ne l'a encore lu."
DE = "Die Zusammenfassung des Berichts wurde vor der Übergabe von der Gruppe geschrieben und dann nicht gelesen."


def test_model_tells_languages_apart():
    train = [("en", EN * 3), ("fr", FR * 3), ("de", DE * 3)]
    m = L.ByteModel(train)
    for lang, text in (("en", "it was written before the release"), ("fr", "avant la livraison du rapport"), ("de", "wurde vor der Gruppe geschrieben"), ("fr", "AVANT LA LIVRAISON DU RAPPORT"), ("fr", "a ete ecrit par l'equipe")):
        bits = m.lengths([text.encode()])[0]
        assert m.langs[bits.argmin()] == lang


def test_code_lengths_are_of_a_distribution():
    m = L.ByteModel([("en", EN), ("fr", FR)])
    p = 2.0 ** -m.bits.astype("float64")
    total = p.reshape(-1, 32, 2).sum(1)
    assert total.max() <= 1.01 and total.min() > 0.3  # escapes lose what exclusion would give back


def test_paragraphs():
    text = f"# A heading of more than six words here\n\n{EN}\n\n```py\nx = 1\n\ny = (the words in this are not prose)\n```\n\n    INFO 11:18:28 something: not found here at all\n\n- {FR}\n\nshort one\n\n{{\"a\": \"b\"}}\n\nlet x = call(this, that, and, the, other);"
    got = [(text[a:b].strip()[:12], p) for a, b, p in L.paragraphs(text)]
    assert [t for t, p in got if p] == [EN[:12], ("- " + FR)[:12], "short one"]


def test_labels(spark):
    labels = ["en", "EN", "en-US", "en_GB", "eng", "English", " english ", "xx", "", None, "und", "enx", "German"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(L.named(F.col("l"), F.lit("en"))).collect()] == [True] * 7 + [False] * 6


def test_rows(spark):
    samples = spark.createDataFrame([("en", EN), ("fr", FR), ("de", DE), (None, "x"), ("de", None)], "lang string, text string")
    docs = spark.createDataFrame([(1, EN, "en", "q"), (2, f"{EN}\r\n\r\n{FR}\n\n{FR}\n\n{EN}", "en", "q"), (3, DE.upper(), None, "q"), (4, None, "en", "q"), (5, "", None, "q"), (6, "one two", "fr", "q"), (7, FR, "French", "q"), (8, FR * 200, "de", "q")], "doc_id long, text string, lang string, segment string")
    assert rows(L.mislabelled(docs, samples)) == [(2, "fr"), (3, "de"), (8, "fr")]
    seg = L.segments(docs, samples).filter("doc_id = 2").orderBy("segment").collect()
    assert [r.lang for r in seg] == ["en", "fr", "en"] and all(0 <= r.confidence <= 1 for r in seg)
    d = {r.doc_id: r for r in L.document_languages(docs, samples).collect()}
    assert len(d) == 8 and d[4].lang is None and d[4].confidence == 0 and d[2].languages == 2 and d[7].label_ok and not d[8].label_ok
    assert L.mislabelled(docs.limit(0), samples).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    s = [(r.lang, r.text) for r in spark.read.parquet(f"{DATA}/lang_samples.parquet").orderBy("sample_id").collect()]
    m = L.ByteModel(s[::2])
    bits = m.lengths([" ".join(L.strip_code(t).split()).encode() for _, t in s[1::2]])
    right = sum(m.langs[k] == lang for k, (lang, _) in zip(bits.argmin(1), s[1::2]))
    assert right / len(s[1::2]) >= 0.98


def test_prose_in_tags_at_any_length():
    for n in (1, 2, 5, 30):
        for text in (f"<p>{EN * n}</p>", f'<div class="note"><p>{FR * n}</p></div>'):
            assert [p for _, _, p in L.paragraphs(text)] == [True]
        for text in ("<a><b>value</b>" * n + "</a>", f'<item name="the words in a tag are not prose at all {n}"/>' * n, "<script>let a = 1; let b = 2; if (a == b) { run(a, b); }</script>"):
            assert [p for _, _, p in L.paragraphs(text)] == [False]
