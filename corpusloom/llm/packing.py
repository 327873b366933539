"""Filling fixed-capacity containers with texts (problem 8) by shortest-pack-first over the length histogram."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, written

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the rank file; a fixed value of that public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def _encode(enc, text: str, block: int = 1 << 20) -> list[int]:
    """Tokens of a whole text. Very long texts go block by block, cut before a space that follows a
    non-space, where the split pattern always starts a new word; so the tokens are the same."""
    if len(text) <= block:
        return enc.encode_ordinary(text)
    out, at = [], 0
    while at < len(text):
        end = at + block
        while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
            end += 1
        out += enc.encode_ordinary(text[at:end])
        at = end
    return out


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row for each document, several for one above the capacity: (doc_id, piece, first_token, n_tokens).

    A null or empty text has no tokens and gives no row: it needs no room.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, pattern)
        for b in batches:
            ids, piece, first, size = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(_encode(enc, t))
                for k, a in enumerate(range(0, n, capacity)):
                    ids.append(i)
                    piece.append(k)
                    first.append(a)
                    size.append(min(capacity, n - a))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(size, pa.int32())], ["doc_id", "piece", "first_token", "n_tokens"])

    texts = documents.select(F.col("doc_id").cast("long"), "text").filter("text is not null and text <> ''")
    return spread(texts).mapInArrow(count, "doc_id long, piece int, first_token long, n_tokens int")


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns as (count, ((length, how many), ...)), from the histogram alone.

    Lengths are placed longest first. Each goes to the kind of open pack with most room, as many packs
    of the kind as there are items; where no pack has room, new packs open. Packs left with no room that
    the shortest length could use are closed at once.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    open_: dict[int, list[list]] = {}  # room -> [count, {length: times}]
    done: list[list] = []
    shortest = min(histogram, default=0)

    def put(room: int, count: int, pattern: dict[int, int]) -> None:
        if room < shortest:
            done.append([count, pattern])
            return
        for kind in open_.setdefault(room, []):
            if kind[1] == pattern:
                kind[0] += count
                return
        open_[room].append([count, pattern])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_, default=0)
            if room < length:
                # what is left opens packs of its own, as full as the length allows
                per = 1 if 2 * length > capacity else capacity // length
                whole, rest = divmod(left, per)
                if whole:
                    put(capacity - per * length, whole, {length: per})
                if rest:
                    put(capacity - rest * length, 1, {length: rest})
                break
            kinds = open_[room]
            count, pattern = kinds.pop()
            if not kinds:
                del open_[room]
            take = min(count, left)
            if take < count:
                put(room, count - take, pattern)
            put(room - length, take, {**pattern, length: pattern.get(length, 0) + 1})
            left -= take
    for kinds in open_.values():
        done += kinds
    return [(n, tuple(sorted(p.items(), reverse=True))) for n, p in done]


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, rank_block: int = 1_000_000) -> DataFrame:
    """Containers of all texts: (doc_id, piece, first_token, n_tokens, container, place).

    Only the histogram, of at most ``capacity`` lengths, reaches the driver. Pieces get a rank among those
    of their length, counted in blocks of about ``rank_block`` rows so that no length, however common, is
    ranked by one task; the rank finds the piece's pattern and container. Places are by falling length.
    """
    pieces = written(token_pieces(documents, capacity, vocabulary), "pieces")
    spark = documents.sparkSession
    blocks = max(8, pieces.count() // rank_block + 1)
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    counts = pieces.groupBy("n_tokens", "_b").agg(F.count(F.lit(1)).alias("_c"))
    hist = {r[0]: r[1] for r in counts.groupBy("n_tokens").agg(F.sum("_c")).collect()}
    slots, base, used = [], 0, dict.fromkeys(hist, 0)
    for count, pattern in plan_packs(hist, capacity):
        place = 0
        for length, times in pattern:
            slots.append((length, used[length], used[length] + count * times, base, times, place))
            used[length] += count * times
            place += times
        base += count
    plan = spark.createDataFrame(slots, "n_tokens int, _from long, _to long, _base long, _times long, _place long")
    before = counts.select("n_tokens", "_b", F.coalesce(F.sum("_c").over(Window.partitionBy("n_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "_b").orderBy("doc_id", "piece", "first_token")) - 1
    ranked = pieces.withColumn("_r", rank).join(before, ["n_tokens", "_b"]).withColumn("_r", F.col("_r") + F.col("_before"))
    # at most a few rows for each of the lengths: the plan's size depends on the capacity, not on the data
    at = ranked.join(F.broadcast(plan), "n_tokens").filter("_r >= _from and _r < _to")
    off = F.col("_r") - F.col("_from")
    return at.select(
        "doc_id", "piece", "first_token", "n_tokens",
        (F.col("_base") + F.floor(off / F.col("_times"))).cast("long").alias("container"),
        (F.col("_place") + off % F.col("_times")).cast("int").alias("place"),
    )


def pack_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, and the part of the room that is used."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("p"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), (F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("used"))
