import random

from conftest import rows

from corpusloom.llm import leakage as L

R = random.Random(3)
WORDS = [f"{a}{b}{c}" for a in "bdfk" for b in ("ale", "oru", "imi") for c in ("n", "t", "sta")]


def sentence(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


ITEMS = [(i, " ".join(sentence(40, i)).capitalize() + ".") for i in range(12)] + [(50, "too short an item"), (51, ""), (52, ITEM := " ".join(sentence(11, 99)))]


def documents():
    out = []
    for i, text in ITEMS[:12]:
        w = text.split()
        noise = sentence(60, 1000 + i)
        at = R.randint(0, len(w) - 15)
        out.append((100 + i, " ".join(noise + w[at : at + 10] + noise)))
        out.append((200 + i, " ".join(noise + w[at : at + 9] + noise)))
        out.append((300 + i, " ".join(noise).upper() + " >> " + "\n ".join(x + "," for x in w[at : at + 12]).upper() + " -- "))
        out.append((400 + i, " ".join(x[:2] + "\u00ad" + x[2:] + "\u200b" for x in w[at : at + 14])))
    return [*out, (900, None), (901, ""), (902, "a b"), (903, ITEM), (904, "x" * 100_000), (903, ITEM)]


def brute(docs, items, n=10):
    g = {}
    for i, t in items:
        w = L.normal(t).split()
        for k in range(len(w) - n + 1):
            g.setdefault(b" ".join(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = L.normal(t or "").split()
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in g.get(b" ".join(w[k : k + n]), ())}
    return sorted(out, key=repr)


def frames(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_equals_brute_force(spark):
    docs = documents()
    want = brute(docs, ITEMS)
    assert len(want) > 36
    assert rows(L.leaked(*frames(spark, docs))) == want


def test_blocks_of_items(spark, monkeypatch):
    docs = documents()
    whole = rows(L.leaked(*frames(spark, docs)))
    monkeypatch.setattr(L, "ITEM_BYTES", 2000)
    assert rows(L.leaked(*frames(spark, docs))) == whole


def test_edits_are_reported(spark):
    w = ITEMS[3][1].split()
    text = " ".join(w[:12]) + " " + w[12][:-1] + " " + " ".join(w[13:30])
    got = [r for r in L.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() if r.item_id == 3]
    assert len(got) == 1 and got[0].words >= 15 and got[0].edits >= 1 and got[0].bytes > 100


def test_empty(spark):
    d, i = frames(spark, documents())
    assert L.leaked(d.limit(0), i).count() == 0 and L.leaked(d, i.limit(0)).count() == 0
    assert L.leaked(d, i.filter("item_id = 50")).count() == 0
