import random

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import neardup as N


def sets(text, width=3):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


@given(st.integers(1, 260), st.integers(0, 10**6), st.sampled_from([0.7, 0.8]), st.integers(0, 255))
@settings(max_examples=300, deadline=None)
def test_similar_sets_share_a_signature(n, seed, least, heavy):
    """Sets on the edge of the threshold, with any mix of rare and frequent shingles."""
    r = np.random.default_rng(seed)
    base = np.unique(r.integers(1, 2**63, n + 200, dtype=np.uint64))
    a = base[:n]
    lost = int((1 - least) * n) if seed % 2 else int((1 - least) / (1 + least) * n)
    gone = r.choice(n, min(n, r.integers(0, lost + 1)), replace=False)
    extra = r.integers(0, lost + 1)
    b = np.concatenate((np.delete(a, gone), base[n : n + extra]))
    k = len(np.intersect1d(a, b))
    if not len(b) or k / (len(a) + len(b) - k) < least:
        return
    level = lambda s: np.where((s * np.uint64(2654435761)) % np.uint64(256) < heavy, 90, 8)
    x, y = (N.signatures(np.sort(s), level(np.sort(s)), least) for s in (a, b))
    assert len(np.intersect1d(x, y)) >= N.least_shared(len(a), len(b), least)


def collection():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    out = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice((4, 30, 90, 200)))]
        for k in range(5):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 12))):
                t[r.randrange(len(t))] = r.choice(words)
            out.append((f"d{g}-{k}", " ".join(t)))
    return out + [("copy", out[0][1].upper() + " !"), ("short", "a b"), ("blank", "  "), ("null", None), (out[0][0], "another text of the same id here")]


def brute(docs):
    s = [(i, sets(N_normal(t))) for i, t in docs if t]
    out = set()
    for k, (i, a) in enumerate(s):
        for j, b in s[k + 1 :]:
            if i != j and a and b and len(a & b) >= 0.7 * len(a | b) - 1e-9:
                out.add((min(i, j), max(i, j)))
    return sorted(out)


def N_normal(t):
    import re

    return " ".join(re.findall(r"[^\W_]+", t.lower()))


def test_pairs_equal_brute_force(spark):
    docs = collection()
    df = spark.createDataFrame([(i, t, None) for i, t in docs], "id string, content string, metadata string").repartition(5)
    assert rows(N.similar_pairs(df)) == brute(docs)


def test_text_from_summary_and_damage(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([("a", t, None, 1), ("b", None, '{"summary": "%s"}' % t, 2), ("c", " \n", '{"summary": "%s"}' % t.upper(), 3), ("d", None, "{broken", 4), ("e", None, None, 5), (None, t, None, 6), ("a", t, None, 7)], "id string, content string, metadata string, n long")
    assert rows(N.similar_pairs(df)) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert N.similar_pairs(df.limit(0)).count() == 0


def test_groups(spark):
    docs = collection()
    df = spark.createDataFrame([(i, t, None) for i, t in docs], "id string, content string, metadata string")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute(docs):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.group_id for r in N.groups(df).collect()}
    want = {x: root(x) for x in list(parent)}
    # an id with two texts joins only the rows of the text itself
    assert {k: v for k, v in got.items() if k != "d0-0"} == {k: v for k, v in want.items() if k != "d0-0"}


def test_hot_group_of_copies(spark):
    df = spark.createDataFrame([(f"c{i}", "the same text for all of these rows") for i in range(40)], "id string, text string")
    pairs, members = N.similar(df)
    assert pairs.count() == 0 and members.count() == 40
