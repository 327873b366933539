from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing as P


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
@settings(max_examples=200, deadline=None)
def test_plan_places_everything_within_capacity(hist):
    plan = P.plan_packs(hist, 64)
    placed = Counter()
    for count, pattern in plan:
        assert count > 0 and sum(n * k for n, k in pattern) <= 64
        for n, k in pattern:
            placed[n] += k * count
    assert placed == Counter(hist)


def test_plan_size_does_not_follow_the_counts():
    small, large = ({n: 3 * f for n in range(1, 2048, 7)} for f in (1, 10**9))
    assert len(P.plan_packs(large)) < 3 * len(small) + 2000
    packs = sum(c for c, _ in P.plan_packs(large))
    assert sum(n * c for n, c in large.items()) / (packs * 2048) > 0.97


def test_plan_rejects_what_does_not_fit():
    with pytest.raises(ValueError):
        P.plan_packs({65: 1}, 64)
    assert P.plan_packs({}) == []


def test_rows(spark):
    texts = ["word " * n for n in (1, 5, 50, 900, 900, 900, 5000)] + [None, "", "word " * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("x", "container")
    got = P.pack(df, 1024).collect()
    enc = P._encoder(P.VOCABULARY, P.PATTERN)
    size = {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t}
    by_doc, by_container = Counter(), Counter()
    for r in got:
        by_doc[r.doc_id] += r.n_tokens
        by_container[r.container] += r.n_tokens
    assert by_doc == Counter(size) and max(by_container.values()) <= 1024
    assert len({(r.container, r.place) for r in got}) == len(got)
    assert {r.doc_id for r in got if r.piece} == {6}  # only what exceeds a container is split
    spans = sorted((r.first_token, r.n_tokens) for r in got if r.doc_id == 6)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert sorted(by_container) == list(range(len(by_container)))
    rep = P.pack_report(P.pack(df, 1024), 1024).first()
    assert rep.tokens == sum(size.values()) and rep.pieces == len(got)


def test_rank_blocks_agree(spark):
    df = spark.createDataFrame([(i, "word " * (i % 3)) for i in range(300)], "doc_id long, text string")
    a, b = (P.pack(df, 16, rank_block=k).groupBy("container").sum("n_tokens").count() for k in (10, 10**6))
    assert a == b


def test_long_texts_in_blocks():
    enc = P._encoder(P.VOCABULARY, P.PATTERN)
    t = "Hello, wörld!  it's 12 o'clock\n\n  x " * 300
    assert P._encode(enc, t, block=100) == enc.encode_ordinary(t)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(df).count() == 0 and P.pack_report(P.pack(df)).first().containers == 0
