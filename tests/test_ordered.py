"""Running sums and bursts over groups that span many blocks, against brute force."""

import datetime as dt
import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusloom.operators import analysis, fusion, graph, ordered

T0 = dt.datetime(2025, 1, 1)


@pytest.fixture
def blocks(spark):
    """As many blocks as there are shuffle partitions, however small the data."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sample(n=400, seed=1):
    """(group, time in ms, size): one group holds most rows, one is null; ties and repeated rows."""
    r = random.Random(seed)
    out = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.randrange(0, 40_000), r.choice([0, 1, 5, None])) for _ in range(n)]
    return out + out[:20]


def test_running_sums_span_blocks(spark, blocks):
    data = [(i, *x) for i, x in enumerate(sample())]
    df = spark.createDataFrame(data, "i int, g string, o int, n int")
    cut = ordered.in_blocks(df, ["g"], F.col("o"), F.col("i"))
    assert cut.filter("g = 'hot'").select("_p").distinct().count() > 1
    want = []
    for g in {x[1] for x in data}:
        total = 0
        for k, x in enumerate(sorted((x for x in data if x[1] == g), key=lambda x: (x[2], x[0]))):
            total += x[3] or 0
            want.append((x[0], total, k + 1))
    got = ordered.running(df, ["g"], F.col("n"), F.col("o"), F.col("i")).select("i", "cum", "rn")
    assert rows(got) == sorted(want, key=repr)
    assert rows(fusion.within_budget(df, F.col("n"), 9, ["g"], F.col("o"), F.col("i")).select("i")) == sorted([(w[0],) for w in want if w[1] <= 9 or w[2] == 1], key=repr)
    assert ordered.running(df.limit(0), ["g"], F.col("n"), F.col("o")).count() == 0


@pytest.mark.parametrize("gap", [0, 50, 100, 400, 100_000])
def test_bursts_span_blocks(spark, blocks, gap):
    data = [(g, T0 + dt.timedelta(milliseconds=t)) for g, t, _ in sample()]
    df = spark.createDataFrame(data, "g string, ts timestamp")
    want = []
    for g in {x[0] for x in data}:
        times = sorted(t for k, t in data if k == g)
        runs = [[times[0]]]
        for a, b in itertools.pairwise(times):
            if (b - a) / dt.timedelta(milliseconds=1) > gap:
                runs.append([])
            runs[-1].append(b)
        want += [(g, x[0], x[-1], len(x)) for x in runs]
    assert rows(ordered.bursts(df, ["g"], "ts", gap * 1000).select("g", "first_ts", "last_ts", "n")) == sorted(want, key=repr)


def test_bursts_without_times(spark, blocks):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", T0), (None, T0)], "g string, ts timestamp")
    assert rows(ordered.bursts(df, ["g"], "ts", 1000).select("g", "n")) == [("a", 1), ("a", 2), (None, 1)]
    assert ordered.bursts(df.limit(0), ["g"], "ts", 1000).count() == 0


def test_joined_text_in_parts(spark, blocks):
    data = [("k", f"{i:03d}", "x" * (i % 7) if i % 11 else None) for i in range(60)] + [("k", "003", "xxx"), (None, "1", "y")]
    df = spark.createDataFrame(data, "k string, o string, t string")
    whole = rows(analysis.joined_text(df, ["k"], ["o"], F.col("t"), "-").select("k", "text"))
    assert whole == sorted([("k", "-".join(t for _, _, t in sorted(x for x in data if x[0] == "k" and x[2] is not None))), (None, "y")], key=repr)
    parts = analysis.joined_text(df, ["k"], ["o"], F.col("t"), "-", most=10).filter("k = 'k'").orderBy("part").collect()
    assert len(parts) > 5 and "-".join(p.text for p in parts) == whole[0][1] and all(len(p.text) <= 10 + 7 for p in parts)


def test_implements_by_the_rarest_method(spark):
    r = random.Random(3)
    sets = {f"t{i}": {m for m in "abcdefgh" if r.random() < 0.5} for i in range(40)} | {f"i{i}": {m for m in "abcdefghz" if r.random() < 0.25} for i in range(20)}
    data = [(k, k, "struct" if k[0] == "t" else "interface", "{" + ", ".join(f'"method:{m}": ""' for m in sorted(s)) + "}") for k, s in sets.items()]
    df = spark.createDataFrame(data, "id string, name string, node_type string, structural_metadata string")
    want = [(t, i) for t in sets for i in sets if t[0] == "t" and i[0] == "i" and sets[i] and sets[i] <= sets[t]]
    assert rows(graph.implements(df)) == sorted(want, key=repr)
    both = [(a, b) for a in sets for b in sets if a != b and a[0] == b[0] == "t" and sets[b] and sets[b] <= sets[a]]
    assert rows(graph.implements(df, graph.TYPES, graph.TYPES)) == sorted(both, key=repr)
