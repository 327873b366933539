"""Exact, quantised and inverted-list vector search. Arithmetic is in doubles; ties go to the smaller id."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

QUERY_BLOCK = 2048
JOIN_BLOCK = 12_288
#: Pivots that a join by cosine chooses from, the sample that they are fitted on, and the costs it weighs.
PIVOTS, PIVOT_SAMPLE, PAIR_NS, COPY_NS = (1, 4, 16, 64, 256, 1024), 16_384, 5, 10_000


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; a vector no longer than 1e-9 is left as it is."""
    n = norm(v)
    return F.when(n > 1e-9, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def quantize(v: Column) -> Column:
    """A signed byte for each component of the unit vector, times 127."""
    return F.transform(l2_normalize(v), lambda x: F.round(x * 127).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", same: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest of ``vectors`` (id, v) for every row of ``queries`` (id, v).

    ``l2`` gives distances, ``cosine`` similarities. Queries go out in blocks of about ``block``, one after another,
    so that the driver and a task hold one block; every task keeps only its best k for each query, and nothing
    but those is shuffled. ``same`` allows a vector to find itself. Null vectors and ids give no rows.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["id"]
    src = vectors.select("id", "v").filter("id is not null and v is not null")
    asks = queries.select("id", "v").filter("id is not null and v is not null")
    rows = asks.limit(block + 1).toArrow()
    if not len(rows):
        return spark.createDataFrame([], f"query_id {kind}, id {kind}, score double, rank int")

    def found(rows: pa.Table) -> DataFrame:
        rows = rows.sort_by("id").combine_chunks()
        ids, q = np.array(rows.column("id").to_pylist()), np.asarray(rows.column("v").combine_chunks().flatten(), np.float64).reshape(len(rows), -1)
        shared = spark.sparkContext.broadcast((ids, q))  # a block's size is fixed
        return src.mapInArrow(lambda it: _best(it, *shared.value, k, metric, same), f"query_id {kind}, id {kind}, score double")

    if len(rows) <= block:
        out = found(rows)
    else:
        parts = -(-asks.count() // block)
        held = written(asks.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), "queries")
        out = None
        for p in range(parts):
            rows = held.filter(F.col("part") == p).select("id", "v").toArrow()
            if len(rows):
                part = written(found(rows), "nearest")
                out = part if out is None else out.unionByName(part)
    score = F.round("score", 9)
    order = [score, F.col("id")] if metric == "l2" else [score.desc(), F.col("id")]
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def _best(batches, qi: np.ndarray, q: np.ndarray, k: int, metric: str, same: bool):
    """The k best of all rows of a task for every query."""
    keep_i = keep_s = b = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        i = np.array(b.column(0).to_pylist())
        x = np.asarray(b.column(1).flatten(), np.float64).reshape(n, -1)
        if metric == "l2":
            s = np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in q])
        else:
            s = -(q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None], 1e-300)
        if not same:
            s[qi[:, None] == i[None, :]] = np.inf
        i = np.broadcast_to(i, s.shape)
        if keep_s is not None:
            s, i = np.concatenate((keep_s, s), 1), np.concatenate((keep_i, i), 1)
        order = np.lexsort((i, np.round(s, 9)), axis=1)[:, :k]
        keep_s, keep_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    if keep_s is not None:
        ok = np.isfinite(keep_s)
        who = np.repeat(qi, keep_s.shape[1]).reshape(keep_s.shape)
        yield pa.RecordBatch.from_arrays([pa.array(who[ok], b.column(0).type), pa.array(keep_i[ok], b.column(0).type), pa.array(keep_s[ok] if metric == "l2" else -keep_s[ok])], ["query_id", "id", "score"])


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors as one class: (id, v, size), the id the least of the class; and (id, rep), the other ids of classes of several."""
    one = written(vectors.filter("id is not null and v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")), "vector-classes")
    several = one.filter("size > 1").select("v", F.col("id").alias("rep"))
    return one, vectors.join(several, "v").filter("id <> rep").select("id", "rep")


def _units(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = np.asarray(col.flatten(), np.float64).reshape(len(col), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Cells:
    """Cells around pivots on the unit sphere, and the cells in which a vector's partners can lie.

    A vector belongs to its nearest pivot. A partner no farther than ``reach`` that belongs to another pivot lies
    beyond the plane between the two, so a cell whose plane is farther away than that holds none.
    """

    def __init__(self, pivots: np.ndarray, least: float):
        self.p = pivots
        self.reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-4
        self.gap = 2 * np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def of(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home, near): the cell of each vector, and which later cells can hold partners of it."""
        d = 2 - 2 * u @ self.p.T
        home = d.argmin(1)
        near = d - d[np.arange(len(d)), home][:, None] <= self.gap[home] * self.reach
        return home, near & (np.arange(len(self.p))[None, :] > home[:, None])


def fit_cells(sample: np.ndarray, rows: int, least: float, block: int = JOIN_BLOCK, seed: int = 3) -> Cells:
    """Cells for a collection of ``rows`` vectors: of several numbers of pivots the one that, judged by the
    sample of unit vectors, costs least in comparisons and in copies sent to cells and blocks together."""
    rng, best, dim = np.random.default_rng(seed), None, sample.shape[1]
    for k in PIVOTS:
        if best is not None and k * 8 > len(sample):
            break
        p, part = sample[rng.choice(len(sample), k, replace=False)], sample[: 16 * k]
        for _ in range(5 if k > 1 else 0):
            at = (part @ p.T).argmax(1)
            sums = np.stack([np.bincount(at, part[:, c], k) for c in range(dim)], 1)
            n = np.linalg.norm(sums, axis=1, keepdims=True)
            p = np.where(n > 1e-9, sums / np.maximum(n, 1e-9), p)
        cells = Cells(p, least)
        home, near = cells.of(sample[:4096])
        share, visits = np.bincount(home, minlength=k) / len(home), near.mean(0)
        holds, asks = (np.maximum(1, np.ceil(x * rows / block)) for x in (share, visits))
        pairs = rows * ((visits * share).sum() + (share**2).sum() / 2)
        cost = pairs * PAIR_NS + ((share * (holds + asks - 1)).sum() + (visits * holds).sum()) * COPY_NS
        if best is None or cost < best[0]:
            best = cost, cells
    return best[1]


def cosine_pairs(vectors: DataFrame, least: float, block: int = JOIN_BLOCK, sample: int = PIVOT_SAMPLE) -> DataFrame:
    """(id_a, id_b, score), the smaller id first: all pairs of ``vectors`` (id, v) with a cosine of ``least`` or more.

    Exact. Vectors lie in cells around pivots, fitted on at most ``sample`` of them, those with the least hashes;
    each is compared within its cell and goes to the later cells that can hold a partner. How many those are depends
    on the data: few for high thresholds or grouped vectors, all in the worst case, where the work grows with the square
    of the rows. Cells are worked in blocks of about ``block``. Single precision with a margin names candidates;
    doubles decide. Ids are unique, vectors of one length, ``least`` is positive; null ids and vectors have no pairs.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter("id is not null and v is not null")
    kind, vec = (dict(vectors.dtypes)[c] for c in ("id", "v"))
    n = vectors.count()
    fit = vectors.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).toArrow()
    if not len(fit):
        return spark.createDataFrame([], f"id_a {kind}, id_b {kind}, score double")
    cells = spark.sparkContext.broadcast(fit_cells(_units(fit.column("v")), n, least, block))  # at most max(PIVOTS) vectors

    def count(batches):
        total = np.zeros((len(cells.value.p), 2), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                home, near = cells.value.of(_units(b.column(1).slice(at, 4096)))
                total[:, 0] += np.bincount(home, minlength=len(total))
                total[:, 1] += near.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["cell", "holds", "visits"])

    src = vectors.select("id", "v")
    sizes = src.mapInArrow(count, "cell int, holds long, visits long").groupBy("cell").agg(F.sum("holds"), F.sum("visits")).collect()  # a row a cell
    parts = {r[0]: tuple(max(1, -(-x // block)) for x in r[1:]) for r in sizes}

    def route(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = b.slice(at, 4096)
                home, near = cells.value.of(_units(x.column(1)))
                who, cell = np.nonzero(near)
                who, cell = np.concatenate((np.arange(len(home)), who)), np.concatenate((home, cell)).astype(np.int32)
                held = np.arange(len(who)) < len(home)  # by its cell; the others visit
                for a in range(0, len(who), 16_384):
                    w = pa.array(who[a : a + 16_384])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 16_384]), pa.array(held[a : a + 16_384]), x.column(0).take(w), x.column(1).take(w)], ["cell", "held", "id", "v"])

    routed = src.mapInArrow(route, f"cell int, held boolean, id {kind}, v {vec}")
    size = lambda i: F.create_map(*[F.lit(v) for c, p in parts.items() for v in (c, p[i])])[F.col("cell")].cast("int")
    # the held of a cell lie in blocks, and each two blocks are a group, each block with itself too; the first block
    # of visitors goes to those, each further one makes a group of its own with every block of the held
    at = F.pmod(F.xxhash64("id"), F.when(F.col("held"), size(0)).otherwise(size(1))).cast("int")
    group = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.transform(upto(F.col("blocks")), lambda o: group(F.least(o, F.col("at")), F.greatest(o, F.col("at"))))
    more = F.when(F.col("visitors") > 1, F.transform(F.sequence(F.lit(1), F.col("visitors") - 1), lambda q: group(F.col("at"), F.col("blocks") + q - 1))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    to = F.transform(upto(F.col("blocks")), lambda h: group(h, F.when(F.col("at") == 0, h).otherwise(F.col("blocks") + F.col("at") - 1)))
    split = routed.withColumns({"at": at, "blocks": size(0), "visitors": size(1)}).withColumn("g", F.explode(F.when(F.col("held"), F.concat(own, more)).otherwise(to)))
    split = split.select("cell", F.col("g.a").alias("a"), F.col("g.b").alias("b"), "held", "at", "id", "v")

    def near(t: pa.Table) -> pa.Table:
        ids, held, at = t.column("id").combine_chunks(), t.column("held").to_numpy(), t.column("at").to_numpy()
        x = _units(t.column("v"))
        u, names = x.astype(np.float32), np.array(ids.to_pylist(), dtype=object)
        first, second = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        b, a = np.nonzero(held & (at == first))[0], np.nonzero(~held | (at == second))[0]
        across, right_side, left, right, scores = first != second, u[b].T, [], [], []
        for k in range(0, len(a), 512):
            i, j = np.nonzero(u[a[k : k + 512]] @ right_side >= least - 1e-5)
            i, j = a[i + k], b[j]
            once = across | ~held[i] | (names[i] < names[j]).astype(bool)
            i, j = i[once], j[once]
            s = np.einsum("ij,ij->i", x[i], x[j])
            ok = s >= least
            left.append(i[ok]), right.append(j[ok]), scores.append(s[ok])
        i, j, s = (np.concatenate(y) if y else np.zeros(0, d) for y, d in ((left, np.int64), (right, np.int64), (scores, np.float64)))
        return pa.table([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s)], ["p", "q", "s"])

    found = split.groupBy("cell", "a", "b").applyInArrow(near, f"p {kind}, q {kind}, s double")
    return found.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), F.col("s").alias("score"))


def similar(vectors: DataFrame, least: float) -> DataFrame:
    """(kind, id_a, id_b, score): all rows with a cosine of ``least`` or more, no partner left out.

    ``copy``: id_b has the vector of id_a, the least id with it. ``near``: a pair of such least ids. The other
    pairs follow: those within a class, and of two near classes any id with any.
    """
    one, copies = classes(vectors)
    near = cosine_pairs(one.select("id", "v"), least).select(F.lit("near").alias("kind"), "id_a", "id_b", F.round("score", 6).alias("score"))
    return near.unionByName(copies.select(F.lit("copy").alias("kind"), F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("score")))


def nearest_above(vectors: DataFrame, least: float) -> DataFrame:
    """(query_id, id, score, rank): the nearest other row of every row by cosine, where that is above ``least``; ties as in ``knn``."""
    one, copies = classes(vectors)
    near = cosine_pairs(one.select("id", "v"), least).filter(F.col("score") > least)
    both = near.select(F.col("id_a").alias("rep"), F.col("id_b").alias("id"), "score").unionByName(near.select(F.col("id_b").alias("rep"), F.col("id_a").alias("id"), "score"))
    found = lambda id, s: F.struct((-F.round(s, 9)).alias("d"), id.alias("id"), s.alias("s"))
    best = both.groupBy("rep").agg(F.min(found(F.col("id"), F.col("score"))).alias("e"))
    # a copy finds the least id of its class, that id the next one
    own = copies.select(F.col("id").alias("query_id"), found(F.col("rep"), F.lit(1.0)).alias("e"))
    own = own.unionByName(copies.groupBy("rep").agg(F.min("id").alias("id")).select(F.col("rep").alias("query_id"), found(F.col("id"), F.lit(1.0)).alias("e")))
    ids = one.select(F.col("id").alias("query_id"), F.col("id").alias("rep")).unionByName(copies.select(F.col("id").alias("query_id"), "rep"))
    every = ids.join(best, "rep").select("query_id", "e").unionByName(own.filter(F.lit(least < 1)))
    return every.groupBy("query_id").agg(F.min("e").alias("e")).select("query_id", "e.id", F.round("e.s", 6).alias("score"), F.lit(1).alias("rank"))


def nearest_to(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """(id, distance): top k of one query vector as a literal, the filter before it; a scan and a heap, no shuffle."""
    q = F.array(*[F.lit(float(x)) for x in query])
    src = vectors if where is None else vectors.filter(where)
    return src.filter("v is not null").select("id", F.round(F.sqrt(distance2(F.col("v"), q)), 6).alias("distance")).orderBy("distance", "id").limit(k)


def ivf_fit(vectors: DataFrame, lists: int = 16, sample: int = 20_000, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds over at most ``sample`` vectors, those with the least hashes."""
    x = np.array([r[0] for r in vectors.filter("v is not null").select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).select("v").toLocalIterator()], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def ivf_knn(vectors: DataFrame, queries: DataFrame, k: int, lists: int = 16, probes: int = 6) -> DataFrame:
    """(query_id, id, score, rank) like ``knn``, by an index of ``lists`` lists.

    The ``probes`` lists whose centroids are nearest to the query come first. Of the others only those are
    left out that can hold nothing as near as the k found: a vector of a list is no farther from its own centroid
    than from another, so the plane between the two bounds its distance from the query. No neighbour is lost.
    """
    c = ivf_fit(vectors, lists)
    if not len(c):
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    centroids = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in c])
    apart = F.array(*[F.array(*[F.lit(float(np.linalg.norm(x - y))) for y in c]) for x in c])
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(c) - 1)), lambda j: F.struct(distance2(F.col("v"), F.element_at(centroids, j + 1)).alias("d"), j.alias("j"))))
    index = vectors.filter("v is not null").select("id", "v", ranked[0]["j"].alias("list"))
    asks = queries.filter("v is not null").select(F.col("id").alias("query_id"), F.col("v").alias("q"), ranked.alias("r"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9), "id")

    def best(asked: DataFrame) -> DataFrame:
        pairs = asked.join(index, "list").filter("query_id <> id").select("query_id", "id", F.sqrt(distance2(F.col("v"), F.col("q"))).alias("score"))
        return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    first = best(asks.select("query_id", "q", F.explode(F.slice("r", 1, probes)).alias("e")).select("query_id", "q", F.col("e.j").alias("list")))
    reach = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("reach"))
    own = F.col("r")[0]
    gap = F.element_at(F.element_at(apart, own["j"] + 1), F.col("e.j") + 1)
    # unknown, and so never too far, where fewer than k were found or two centroids coincide
    far = F.coalesce((F.col("e.d") - own["d"]) / F.nullif(2 * gap, F.lit(0.0)) > F.col("reach") + 1e-6, F.lit(False))
    rest = asks.join(reach, "query_id", "left").withColumn("e", F.explode(F.slice("r", probes + 1, len(c)))).filter(~far).select("query_id", "q", F.col("e.j").alias("list"))
    found = first.unionByName(best(rest)).drop("rank")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def hashed_embedding(dim: int = 64):
    """A deterministic stand-in for a model: signed counts of token hashes, brought to unit length.

    Returns a pandas UDF; nulls and empty texts give zeros.
    """
    import xxhash

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        out = []
        for t in text.fillna(""):
            v = np.zeros(dim, np.float32)
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed
