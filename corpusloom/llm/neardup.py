"""Near-duplicate texts (problem 4) by prefixes of token combinations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

WIDTH, LEAST = 3, 0.7
#: Frequency sketch: 2**SKETCH_BITS counters, whatever the data's size.
SKETCH_BITS, SKETCH_BLOCK = 22, 4096
#: A shingle above this count is frequent: it is indexed in pairs, within one of PARTS classes.
FREQUENT, PARTS = 48, 32

_words: dict[str, int] = {}


def _shingles(text: str, width: int) -> np.ndarray:
    """Distinct hashes of the sequences of ``width`` words of a normalised text, sorted."""
    w = text.split()
    if len(w) < width:
        return np.zeros(0, np.uint64)
    if len(_words) > 1 << 20:
        _words.clear()
    h = []
    for x in w:
        v = _words.get(x)
        if v is None:
            v = _words[x] = xxhash.xxh64_intdigest(x)
        h.append(v)
    a = np.array(h, np.uint64)
    n = len(a) - width + 1
    s = np.zeros(n, np.uint64)
    for k in range(width):
        s = (s ^ a[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return np.unique(s)


def normal_words(text):
    """Column: the words (runs of letters and digits, lower case) of a text column, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def record_text(content, metadata):
    """Column: the content or, where that is null or blank, the summary of the metadata."""
    return F.when(F.coalesce(content, F.lit("")).rlike(r"\S"), content).otherwise(F.get_json_object(metadata, "$.summary"))


def _sketch(classes: DataFrame, width: int) -> np.ndarray:
    """Counts of all shingles, by the first bits of their hash, as logarithms in eighths."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            part = [_shingles(t, width) for t in b.column(0).to_pylist()]
            if part:
                c += np.bincount((np.concatenate(part) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(c))
        for k, block in enumerate(c.reshape(-1, SKETCH_BLOCK)):
            if block.any():
                small = block.astype(np.uint8) if block.max() < 256 else block
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([small.itemsize], pa.int32()), pa.array([small.tobytes()], pa.binary())], ["k", "size", "c"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint8 if s == 1 else np.int64).astype(np.int64) for s, c in zip(t.column("size").to_pylist(), t.column("c").to_pylist()))
        return pa.table({"k": t.column("k").slice(0, 1), "c": pa.array([np.minimum(255, np.log2(np.maximum(total, 1)) * 8).astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.uint8)
    for k, c in classes.select("text").mapInArrow(count, "k int, size int, c binary").groupBy("k").applyInArrow(add, "k int, c binary").collect():
        out[k * SKETCH_BLOCK : (k + 1) * SKETCH_BLOCK] = np.frombuffer(c, np.uint8)
    return out


def signatures(s: np.ndarray, level: np.ndarray, least: float, frequent: int = FREQUENT, parts: int = PARTS) -> np.ndarray:
    """Hashes under which a set of shingles is indexed, such that any two sets of similarity ``least`` share one.

    With n shingles at most t = n - ceil(least * n) may be missing from a similar set. In the global order
    (rarest first) the prefix grows until the shingles that must be lost to destroy all its combinations
    exceed t: a class indexed by single shingles holds c of them, one indexed by pairs c - 1. A set too
    small for that, and any that may be similar to such a set, is indexed by single shingles as well.
    """
    n = len(s)
    if not n:
        return s
    lost = n - math.ceil(least * n - 1e-9)
    order = np.lexsort((s, level))
    s, level = s[order], level[order]
    small = (parts + 2) / least  # below this, pairs cannot cover every set
    out = []
    if n <= small / least + 1:
        out.append(s[: lost + 1])
    if n >= small:
        rare = level <= int(math.log2(frequent) * 8)
        kind = (s % np.uint64(parts)).astype(np.int64)
        # gain of each further shingle: one, but none for the first of a class of pairs
        gain = np.ones(n, np.int64)
        often = np.flatnonzero(~rare)
        _, first = np.unique(kind[often], return_index=True)
        gain[often[first]] = 0
        end = int(np.searchsorted(np.cumsum(gain), lost + 1)) + 1
        out.append(s[:end][rare[:end]])
        f, g = s[:end][~rare[:end]], kind[:end][~rare[:end]]
        by = np.argsort(g, kind="stable")
        f, g = f[by], g[by]
        for step in range(1, int(np.bincount(g).max()) if len(g) else 0):
            same = g[step:] == g[:-step]
            a, b = f[:-step][same], f[step:][same]
            out.append((np.minimum(a, b) ^ (np.maximum(a, b) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(np.concatenate(out))


def least_shared(p: int, q: int, least: float) -> int:
    """How many signatures two similar sets of p and q shingles share at least.

    Their overlap is at least o = least / (1 + least) * (p + q), so a set of p loses p - o shingles to the
    other. Its prefix withstands p - ceil(least * p) losses with one signature left, and every loss takes
    at most one away.
    """
    o = math.ceil(least * (p + q) / (1 + least) - 1e-9)
    return max(1, min(n - math.ceil(least * n - 1e-9) + 1 - (n - o) for n in (p, q)))


def similar(texts: DataFrame, width: int = WIDTH, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b, similarity) and the members (n, id) of the classes.

    ``texts`` has id and text. Texts with equal words form one class, so copies make no pairs here. Texts
    of fewer than ``width`` words have no sequences and are similar to nothing. Null ids or texts give no
    rows. All links between different classes are found.
    """
    spark = texts.sparkSession
    # normalised once, for the classes and for their members
    words = texts.select("id", normal_words(F.col("text")).alias("text")).filter("id is not null and text is not null and text <> ''")
    base = written(words.withColumn("key", F.unhex(F.sha2("text", 256))), "words")
    classes = written(base.groupBy("key").agg(F.first("text").alias("text")).withColumn("n", F.monotonically_increasing_id()), "texts")
    members = base.select("key", "id").distinct().join(classes.select("key", "n"), "key").select("n", "id")
    level = spark.sparkContext.broadcast(_sketch(classes, width))  # 2**SKETCH_BITS bytes

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, sig, size = [], [], []
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = _shingles(t, width)
                x = signatures(s, level.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], least)
                sig.append(x.view(np.int64))
                who.append(np.full(len(x), n, np.int64))
                size.append(np.full(len(x), len(s), np.int32))
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, who, size)], ["sig", "n", "size"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # 32 bits tell the few sequences of one pair of texts apart
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(_shingles(t, width).astype(np.uint32)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["n", "s"])

    sig = classes.select("n", "text").mapInArrow(index, "sig long, n long, size int")
    x, y = sig.select("sig", F.col("n").alias("a"), F.col("size").alias("p")), sig.select("sig", F.col("n").alias("b"), F.col("size").alias("q"))
    met = x.join(y, "sig").filter((F.col("a") < F.col("b")) & (F.col("p") >= F.col("q") * least - 1e-9) & (F.col("q") >= F.col("p") * least - 1e-9))
    overlap = F.ceil((F.col("p") + F.col("q")) * (least / (1 + least)) - 1e-9)
    stands = lambda n: overlap - F.ceil(F.col(n) * least - 1e-9) + 1  # noqa: E731  as in least_shared
    candidates = met.groupBy("a", "b", "p", "q").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= F.least(stands("p"), stands("q"))).select("a", "b")
    body = classes.select("n", "text").mapInArrow(sets, "n long, s binary")
    both = candidates.join(body.select(F.col("n").alias("a"), F.col("s").alias("x")), "a").join(body.select(F.col("n").alias("b"), F.col("s").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                u, v = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
                m = np.concatenate((u, v))
                m.sort(kind="stable")
                k = int(np.count_nonzero(m[1:] == m[:-1]))
                sim.append(k / (len(m) - k))
            s = np.array(sim)
            ok = pa.array(s >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(s[s >= least - 1e-12])], ["a", "b", "similarity"])

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, similarity double"), members


def similar_pairs(records: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(id_a, id_b), the smaller first: all pairs of different ids with texts of similarity ``least`` or more, copies included."""
    pairs, members = similar(records.select("id", record_text(F.col("content"), F.col("metadata")).alias("text")), width, least)
    members = written(members, "members")
    left, right = members.select(F.col("n").alias("a"), F.col("id").alias("i")), members.select(F.col("n").alias("b"), F.col("id").alias("j"))
    near = pairs.select("a", "b").join(left, "a").join(right, "b").select("i", "j")
    shared = members.groupBy("n").count().filter("count > 1").select("n")
    many = members.join(shared, "n")
    same = many.select("n", F.col("id").alias("i")).join(many.select("n", F.col("id").alias("j")), "n").filter("i < j").select("i", "j")
    return near.unionByName(same).filter("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def _components(edges: DataFrame) -> DataFrame:
    """(n, root): the least node reachable from each node that has an edge.

    Every round a node takes the least label among its own, its neighbours' and its label's label, so paths
    halve; each round is written to the shared folder, and only a count comes back.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("n"), "l"), "labels")
    while True:
        near = both.join(label, both["b"] == label["n"]).select(F.col("a").alias("n"), "l")
        jump = label.alias("x").join(label.alias("y"), F.col("x.l") == F.col("y.n")).select(F.col("x.n").alias("n"), F.col("y.l").alias("l"))
        new = label.unionByName(near).unionByName(jump).groupBy("n").agg(F.min("l").alias("l"))
        new = written(new, "labels")
        if not new.join(label.withColumnRenamed("l", "old"), "n").filter("l <> old").limit(1).count():
            return new.select("n", F.col("l").alias("root"))
        label = new


def groups(records: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(id, group_id, links): one row for each record with a similar text; groups are joined by links.

    ``links`` counts the different texts that are similar to the record's own; a group of copies alone has
    links 0. ``group_id`` is the least id of the group. An id with several texts joins their groups' rows
    under the least group_id.
    """
    pairs, members = similar(records.select("id", record_text(F.col("content"), F.col("metadata")).alias("text")), width, least)
    members = written(members, "members")
    pairs = written(pairs.select("a", "b"), "links")
    root = _components(pairs)
    links = pairs.select(F.col("a").alias("n")).unionByName(pairs.select(F.col("b").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("links"))
    rows = members.join(root, "n", "left").join(links, "n", "left").select("id", F.coalesce("root", "n").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least_id = rows.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(least_id, "root").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))
