"""The most similar vectors of every vector (problem 6): a forest of random-projection trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: SAMPLE bounds what the forest is fitted on, NODE how much of that a leaf gets where there is enough.
TREES, LEAF, SAMPLE, NODE, BLOCK, SEED = 3, 1600, 131_072, 64, 8192, 7


class Forest:
    """Trees of equal depth in arrays: node i of a tree has the children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        inner, dim = 2**depth - 1, sample.shape[1]
        self.w = np.zeros((trees, inner, dim), np.float32)
        self.t = np.zeros((trees, inner), np.float32)
        for k in range(trees):
            rows = {0: np.arange(len(sample))}
            for i in range(inner):
                own = rows.pop(i)
                w = self._direction(sample, own, rng, dim)
                p = sample[own] @ w
                t = self._threshold(p)
                self.w[k, i], self.t[k, i] = w, t
                rows[2 * i + 1], rows[2 * i + 2] = own[p <= t], own[p > t]

    @staticmethod
    def _direction(sample: np.ndarray, own: np.ndarray, rng, dim: int) -> np.ndarray:
        """Between two random points of the node; any direction where it holds fewer than two."""
        for _ in range(3):
            if len(own) < 2:
                break
            a, b = rng.choice(own, 2, replace=False)
            w = sample[a] - sample[b]
            if (n := np.linalg.norm(w)) > 1e-6:
                return (w / n).astype(np.float32)
        w = rng.standard_normal(dim)
        return (w / np.linalg.norm(w)).astype(np.float32)

    @staticmethod
    def _threshold(p: np.ndarray) -> float:
        """In the widest gap of the middle half: between groups rather than through one."""
        if len(p) < 2:
            return 0.0
        s = np.sort(p)
        a, b = len(s) // 4, max(len(s) // 4 + 1, len(s) * 3 // 4)
        g = a + int(np.argmax(s[a + 1 : b + 1] - s[a:b]))
        return float((s[g] + s[g + 1]) / 2)

    def search(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` leaves (n x probes) that one priority queue shared by all trees pops first, the own leaf
        in every tree before the others. A leaf's priority is the worst margin by which its path leaves the side
        of the query. Leaves are numbered over all trees.

        Every node leads to a leaf of its own priority, so the best ``probes`` leaves lie below the best
        ``probes`` nodes of every level: no others are kept on the way down.
        """
        n, dim = x.shape
        inner, most = self.w.shape[1], max(probes, self.trees)
        w, t = self.w.reshape(-1, dim), self.t.ravel()
        tree = np.tile(np.arange(self.trees), (n, 1))
        node = np.zeros((n, self.trees), np.int64)
        cost = np.full((n, self.trees), -1.0, np.float32)  # -1: the query's own path
        for level in range(self.depth):
            at = tree * inner + 2**level - 1 + node
            m = np.einsum("nbd,nd->nb", w[at], x) - t[at]
            own, left = cost < 0, m <= 0
            cost = np.concatenate((np.where(own & left, -1, np.maximum(np.maximum(cost, m), 0)), np.where(own & ~left, -1, np.maximum(np.maximum(cost, -m), 0))), 1).astype(np.float32)
            tree, node = np.concatenate((tree, tree), 1), np.concatenate((2 * node, 2 * node + 1), 1)
            if cost.shape[1] > most:
                keep = np.argpartition(cost, most - 1, axis=1)[:, :most]
                tree, node, cost = (np.take_along_axis(a, keep, 1) for a in (tree, node, cost))
        order = np.argsort(cost, axis=1, kind="stable")
        return np.take_along_axis(tree * 2**self.depth + node, order, 1)


def usable(records: DataFrame, dim: int = 64) -> DataFrame:
    """(id, vec): each id once, the vector brought to unit length, as float32 bytes.

    A vector is usable if it has ``dim`` finite components that are not all zero. Of several usable vectors
    of one id the latest counts (updated_at of metadata, then the greatest).
    """
    ok = (F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    at = F.coalesce(F.get_json_object("metadata", "$.updated_at").try_cast("long"), F.lit(0))
    one = records.filter(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False))).groupBy("id").agg(F.max(F.struct(at.alias("t"), F.col("vector").alias("v"))).alias("m")).select("id", F.col("m.v").alias("v"))

    def unit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, dim)
            x /= np.abs(x).max(1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4") + np.float32(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "vec"])

    return one.mapInArrow(unit, "id string, vec binary")


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f4").reshape(len(col), -1)


def nearest(records: DataFrame, k: int = 5, dim: int = 64, trees: int = TREES, leaf: int = LEAF, probes: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(id, rank, neighbour, cosine): the ``k`` most similar usable records of every usable record.

    The forest is fitted on at most ``sample`` vectors, those with the least hashes, ``NODE`` for each leaf while
    they last; every vector is indexed and every vector asks. A query visits ``probes`` leaves; if that is not
    given, its own in every tree, three more, and one for every two levels of the trees. Equal vectors are one class in the index; within a class, and
    between equal similarities, ids come by code point. Leaves above ``block`` vectors are worked in
    blocks, none of them dropped. Fewer than two usable records give no rows; extra columns are ignored.
    """
    spark = records.sparkSession
    rows = written(usable(records, dim), "vectors")
    classes = rows.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    classes = written(classes.withColumn("n", F.monotonically_increasing_id()), "vector-classes")
    total = classes.count()
    depth = max(0, min(math.ceil(math.log2(max(1, total / leaf))), int(math.log2(max(1, min(sample, total) // 8)))))
    probes = trees + 3 + depth // 2 if probes is None else max(probes, trees)
    fit = classes.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(min(sample, NODE * 2**depth)).toArrow()
    x = _matrix(fit.column(0)) if len(fit) else np.zeros((1, dim), np.float32)
    forest = spark.sparkContext.broadcast(Forest(x, depth, trees))  # at most sample / 8 nodes a tree
    inner = F.col("n").isNotNull()

    def route(batches):
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                found = forest.value.search(_matrix(b.column(1)), probes)
                who = np.repeat(np.arange(len(found)), found.shape[1])
                member = np.tile(np.arange(found.shape[1]) < trees, len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(member), b.column(0).take(pa.array(who)), b.column(1).take(pa.array(who))], ["leaf", "member", "n", "vec"])

    routed = classes.select("n", "vec").filter(inner).mapInArrow(route, "leaf long, member boolean, n long, vec binary")
    full = {}
    if total > block:  # a leaf can hold more than a block only then
        sizes = classes.select("n", "vec").mapInArrow(_own_leaves(forest), "leaf long").groupBy("leaf").count().filter(F.col("count") > block)
        full = {r[0]: -(-r[1] // block) for r in sizes.collect()}  # by leaf: a bounded number
    if full:
        parts = F.coalesce(F.create_map(*[F.lit(v) for kv in full.items() for v in kv])[F.col("leaf")], F.lit(1))
        spot = F.pmod(F.xxhash64("n"), parts).cast("int")
        # members lie in one block; as queries, members and visitors go to every block, themselves in parts
        asks = routed.withColumn("_m", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).withColumn("_q", spot).withColumn("asks", F.lit(True)).withColumn("holds", F.lit(False))
        has = routed.filter("member").withColumn("_q", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).withColumn("_m", spot).withColumn("asks", F.lit(False)).withColumn("holds", F.lit(True))
        routed = asks.unionByName(has).select("leaf", "_m", "_q", "asks", "holds", "n", "vec")
    else:
        routed = routed.select("leaf", F.lit(0).alias("_m"), F.lit(0).alias("_q"), F.lit(True).alias("asks"), F.col("member").alias("holds"), "n", "vec")

    def best(t: pa.Table) -> pa.Table:
        n, v = t.column("n").to_numpy(), _matrix(t.column("vec"))
        asks, holds = (np.asarray(t.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("asks", "holds"))
        cn, cv = n[holds], v[holds]
        qn, qv = n[asks], v[asks]
        out = []
        for a in range(0, len(qn), 1024):
            if not len(cn):
                break
            s = qv[a : a + 1024] @ cv.T
            s[qn[a : a + 1024, None] == cn[None, :]] = -9
            m = min(k + 2, s.shape[1])
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            ok = np.take_along_axis(s, top, 1) > -2
            # exactly, pair by pair: the same in every leaf where two vectors meet
            near = np.einsum("ijk,ik->ij", cv[top].astype(np.float64), qv[a : a + 1024].astype(np.float64)).astype(np.float32)
            near[~ok] = -9
            best = np.argsort(-near, axis=1, kind="stable")[:, :k]
            top, near = np.take_along_axis(top, best, 1), np.take_along_axis(near, best, 1)
            ok = near > -2
            out.append((np.repeat(qn[a : a + 1024], top.shape[1])[ok.ravel()], cn[top][ok], near[ok]))
        q, c, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        return pa.table({"q": q, "c": c, "s": s.astype(np.float32)})

    found = routed.groupBy("leaf", "_m", "_q").applyInArrow(best, "q long, c long, s float")
    # bounded lists: at most k rows for each of the leaves a query visits
    per = found.groupBy("q").agg(F.collect_set(F.struct((-F.col("s")).alias("d"), "c")).alias("l")).select("q", F.explode(F.slice(F.array_sort("l"), 1, k)).alias("e")).select("q", F.col("e.c").alias("c"), (-F.col("e.d")).alias("s"))
    per = written(per, "neighbour-classes")
    key = classes.select("n", "id", "size", "vec")
    single = key.filter("size = 1").select("n", "id")
    copies = rows.join(key.filter("size > 1").select("n", "vec"), "vec").select("n", "id")
    first = copies.withColumn("_k", F.row_number().over(Window.partitionBy("n").orderBy("id"))).filter(F.col("_k") <= k + 1).select("n", "id")
    heads = single.unionByName(first)
    other = per.join(heads.withColumnRenamed("n", "c"), "c").select("q", "id", "s")
    lists = other.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), F.col("id").alias("id")))).alias("a"))
    own = first.groupBy("n").agg(F.array_sort(F.collect_list(F.struct(F.lit(-1.0).cast("float").alias("d"), F.col("id").alias("id")))).alias("b"))
    everyone = single.join(lists, single["n"] == lists["q"]).select("id", "a")
    several = copies.join(own, "n").join(lists, F.col("n") == F.col("q"), "left").select("id", F.concat(F.filter("b", lambda e: e["id"] != F.col("id")), F.coalesce("a", F.filter("b", lambda e: F.lit(False)))).alias("a"))
    out = everyone.unionByName(several).select("id", F.posexplode(F.slice(F.array_sort("a"), 1, k)).alias("r", "e"))
    return out.select("id", (F.col("r") + 1).alias("rank"), F.col("e.id").alias("neighbour"), (-F.col("e.d")).alias("cosine"))


def _own_leaves(forest):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                own = forest.value.search(_matrix(b.column(1).slice(at, 2048)), 1)
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel())], ["leaf"])

    return run


def close_pairs(records: DataFrame, least: float = 0.8, k: int = 5, **kw) -> DataFrame:
    """(id_a, id_b), the smaller first: pairs of similarity ``least`` or more where one is among the k nearest of the other."""
    near = nearest(records, k, **kw).filter(F.col("cosine") >= least)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
