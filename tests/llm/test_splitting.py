import pytest
from conftest import rows
from hypothesis import example, given, settings
from hypothesis import strategies as st

from corpusloom.llm import splitting as S


@given(st.text(st.sampled_from("ab {}\n;😀\t"), max_size=900), st.integers(20, 120), st.integers(0, 15))
@example(";;;\n;;;;;;;; ;;;;;;;;", 20, 11)
@settings(max_examples=150, deadline=None)
def test_spans_cover_and_fit(text, limit, overlap):
    spans = S.split_text(text, limit, overlap)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap
    if len(text) <= limit:
        assert len(spans) == 1


def test_overlap_is_about_what_was_asked():
    text = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(2000))
    spans = S.split_text(text)
    assert len(spans) > 10 and all(250 <= b - c <= 500 for (_, b), (c, _) in zip(spans, spans[1:]))
    # cuts lie between units
    assert all(text[b - 1] == "\n" and text[b:].startswith("def ") for _, b in spans[:-1])


def test_bad_overlap():
    with pytest.raises(ValueError):
        S.split_text("x" * 50, 10, 10)


def test_rows(spark):
    long = "".join(f"line {i}\n" for i in range(1000))
    schema = "id string, node_type string, content string, start_line int, piece_no int"
    df = spark.createDataFrame([("a", "f", long, 11, 7), ("a", "f", long, 11, 8), ("b", None, "short", 1, 0), ("c", None, long, None, 0), ("d", None, None, 1, 0), ("e", None, "", 1, 0), ("f", "x", long, -5, 0), ("g", "x", "é" * 3001, 1, 0), ("h", "x", "é" * 3000, 1, 0)], schema)
    got = S.split_chunks(df).orderBy("id", "piece_no").collect()
    assert {r.id for r in got} == {"a", "c", "f", "g"}
    a = [r for r in got if r.id == "a"]
    assert [r.piece_no for r in a] == list(range(a[0].n_pieces))
    assert a[0].start_line == 11 and a[-1].end_line == 1010 and [r for r in got if r.id == "c"][0].start_line == 1
    for r in a:
        assert r.content == long[r.char_start : r.char_end] and r.node_type == "f"
        assert r.start_line == 11 + long.count("\n", 0, r.char_start)
    assert rows(S.oversized(df)) == [("a",), ("c",), ("f",), ("g",)]
    assert S.oversized(df.limit(0)).count() == 0
