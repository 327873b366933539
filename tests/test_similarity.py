"""Joins by similarity of all records with all, against brute force."""

import numpy as np
import pytest

from corpusloom.operators import vectors
from corpusloom.plans import catalog


def fixture(spark, d):
    """Groups of near vectors, one of more than ten members; copies, one of them scaled; unusable rows."""
    r = np.random.default_rng(5)
    c = r.standard_normal((12, 64))
    x = np.concatenate([np.repeat(c, 15, 0) + 0.25 * r.standard_normal((180, 64)), np.repeat(c, 3, 0) + 0.08 * r.standard_normal((36, 64))]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 14, 0), x[5:7], 2 * x[9:10]])
    ids = [f"r{i * 7919 % 1000:03d}" for i in range(len(x))]
    extra = [("null", None), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), (None, [1.0] * 64)]
    data = [(i, [float(c) for c in v], None, None) for i, v in zip(ids, x)]
    spark.createDataFrame([*data, data[3], *((i, v, None, None) for i, v in extra)], "id string, vector array<float>, content string, metadata string").write.parquet(f"{d}/records.parquet")
    u = x.astype(np.float64)
    s = u @ u.T / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(u, axis=1)[None]
    return ids, s


def test_near_dup_pairs_have_every_pair(spark, tmp_path):
    ids, s = fixture(spark, str(tmp_path))
    want = {tuple(sorted((ids[i], ids[j]))) for i, j in zip(*np.nonzero(s >= 0.9)) if i < j}
    got = catalog.QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()
    group = {}
    for r in got:
        if r.kind == "copy":
            group.setdefault(r.id_a, {r.id_a}).add(r.id_b)
    pairs = {(a, b) for m in group.values() for a in m for b in m if a < b}
    for r in got:
        if r.kind == "near":
            pairs |= {tuple(sorted((a, b))) for a in group.get(r.id_a, {r.id_a}) for b in group.get(r.id_b, {r.id_b})}
    assert pairs == want
    assert len(got) == len({(r.id_a, r.id_b) for r in got}) and all(r.id_a < r.id_b for r in got)


def test_summary_cache_asks_for_every_record(spark, tmp_path):
    ids, s = fixture(spark, str(tmp_path))
    np.fill_diagonal(s, -9)
    want = {}
    for i, a in enumerate(ids):
        j = min(range(len(ids)), key=lambda j: (-round(s[i, j], 9), ids[j]))
        if s[i, j] > 0.98:
            want[a] = (ids[j], 1)
    got = catalog.QUERIES["summary_semantic_cache"](spark, str(tmp_path)).collect()
    assert {r.query_id: (r.id, r.rank) for r in got} == want and len(got) == len(want)


def test_blocks_lose_and_repeat_no_pair(spark):
    x = np.random.default_rng(6).standard_normal((90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.7)) if i < j)
    assert sorted((r.id_a, r.id_b) for r in vectors.cosine_pairs(df, 0.7, block=20).collect()) == want


@pytest.mark.parametrize("pivots", [(1,), (4,), (16,), (1, 4, 16)])
@pytest.mark.parametrize("least", [0.5, 0.9, 0.99])
def test_cells_lose_no_pair(spark, monkeypatch, pivots, least):
    r = np.random.default_rng(7)
    x = np.concatenate([np.repeat(r.standard_normal((10, 12)), 20, 0) + 0.2 * r.standard_normal((200, 12)), r.standard_normal((100, 12)), np.zeros((1, 12))])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    want = sorted((f"{i:03d}", f"{j:03d}") for i, j in zip(*np.nonzero(u @ u.T >= least)) if i < j)
    monkeypatch.setattr(vectors, "PIVOTS", pivots)
    df = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 12), ("null", None)], "id string, v array<double>")
    for block in (40, 8192):
        assert sorted((a.id_a, a.id_b) for a in vectors.cosine_pairs(df, least, block=block).collect()) == want


def test_pivots_by_cost():
    r = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    grouped = unit(np.repeat(r.standard_normal((200, 64)), 50, 0) + 0.05 * r.standard_normal((10_000, 64)))[r.permutation(10_000)]
    cells = vectors.fit_cells(grouped, 10_000_000, 0.95)
    home, near = cells.of(grouped)
    share = np.bincount(home, minlength=len(cells.p)) / len(home)
    assert len(cells.p) >= 64 and (near @ share).mean() + (share**2).sum() / 2 < 0.1


def test_queries_in_blocks(spark):
    x = np.random.default_rng(10).standard_normal((120, 6))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    for metric in ("l2", "cosine"):
        a, b = (sorted(map(tuple, vectors.knn(v, v.filter("id < 50"), 4, metric, block=n).collect())) for n in (2048, 9))
        assert a == b and len(a) == 200


def test_ivf_recall_at_production_parameters(spark):
    r = np.random.default_rng(8)
    even, groups = r.standard_normal((600, 64)), np.repeat(9 * r.standard_normal((20, 64)), 30, 0) + r.standard_normal((600, 64))
    for x in (even, groups, even[:7]):
        v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
        d = np.sqrt(((x[:20, None] - x[None]) ** 2).sum(2))
        d[np.arange(len(d)), np.arange(len(d))] = np.inf
        want = {(i, int(j)) for i, row in enumerate(d) for j in np.argsort(row)[:10] if np.isfinite(row[j])}
        got = {(a.query_id, a.id) for a in vectors.ivf_knn(v, v.filter("id < 20"), 10).collect()}
        assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)
