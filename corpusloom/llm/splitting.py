"""Splitting oversized items at natural boundaries (problem 2) by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3000, 500

PIECES = "id string, piece_no int, n_pieces int, node_type string, start_line int, end_line int, char_start int, char_end int, content string"

_ATOM = re.compile(r"[^\n]*\n|[^\n]+")
_SOFT = re.compile(r"(?<=[\s,;.(){}\[\]])(?=\S)")
#: Lines that open a new unit of code or prose.
_OPENS = re.compile(r"\s*(?:#|//|/\*|@|\"\"\"|(?:pub|export|async|static|public|private|protected|func|fn|def|class|impl|type|struct|interface|function|const|trait|enum|mod|use|import)\b)")


def _atoms(text: str, most: int) -> list[int]:
    """Start offsets of atomic segments: lines; lines above ``most`` are cut after a separator, else hard."""
    starts = []
    for m in _ATOM.finditer(text):
        a, b = m.span()
        starts.append(a)
        while b - a > most:
            cut = a + most
            for s in _SOFT.finditer(text, a + most // 2, cut):
                cut = s.start()
            starts.append(cut)
            a = cut
    return starts


def _strength(text: str, prev: int, cut: int, end: int) -> float:
    """How natural a boundary at ``cut`` is: weak inside a line, strong between unindented units.

    ``prev`` and ``end`` bound the two atoms that meet there.
    """
    if cut and text[cut - 1] != "\n":
        return 0.0
    before, after = text[prev:cut].rstrip(), text[cut:end]
    body = after.strip()
    indent = len(after) - len(after.lstrip())
    s = 1.0 + 2.0 / (1 + indent)
    if not before:
        s += 3.0
    if before.endswith(("}", "};", "});", "end")):
        s += 1.0
    if before.endswith(("{", "(", ",", "[", ":", "\\")):
        s -= 1.5
    if _OPENS.match(after):
        s += 1.0
    if not body or body[0] in "})]":
        s -= 1.0
    return max(s, 0.1)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Character spans of the pieces of ``text``; each at most ``limit`` long, each but the first sharing
    about ``overlap`` characters with the one before. A text within the limit is one piece; empty gives none.

    Atomic segments start as clusters. A heap holds adjacent pairs, weakest boundary first, and a pair is
    merged while its joint size plus the overlap fits the limit. Ties go to the smaller joint size, then
    to the earlier place.
    """
    n = len(text)
    if not n:
        return []
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    core = limit - overlap
    start = _atoms(text, core)
    k = len(start)
    end = [*start[1:], n]
    right, left = list(range(1, k + 1)), list(range(-1, k - 1))
    alive = [True] * k
    strength = [0.0] * k  # of the boundary before atom i
    for i in range(1, k):
        strength[i] = _strength(text, start[i - 1], start[i], end[i])
    heap = [(strength[i], end[i] - start[i - 1], i) for i in range(1, k)]
    heapq.heapify(heap)
    while heap:
        s, size, i = heapq.heappop(heap)
        if not alive[i] or left[i] < 0:
            continue
        j = left[i]
        now = end[i] - start[j]
        if now > core:
            continue  # clusters only grow: this pair never fits again
        if now != size:
            heapq.heappush(heap, (s, now, i))
            continue
        end[j] = end[i]
        alive[i] = False
        r = right[i]
        right[j] = r
        if r < k:
            left[r] = j
    cores = [(start[i], end[i]) for i in range(k) if alive[i]]
    out = [cores[0]]
    for a, b in cores[1:]:
        at = max(a - overlap, 0)
        nl = text.find("\n", max(at - 1, 0), a - overlap // 2)
        if at and nl >= 0 and a - nl - 1 >= overlap * 3 // 5:
            at = nl + 1
        while out and at <= out[-1][0]:  # a core so short that it lies within the next piece
            out.pop()
        out.append((at, b))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        for id_, node, text, line in zip(*(c.to_pylist() for c in batch.columns)):
            spans = split_text(text, limit, overlap)
            at, seen = 0, 0
            for no, (a, b) in enumerate(spans):
                seen += text.count("\n", at, a)
                at = a
                first = line + seen
                last = first + text.count("\n", a, b - 1)
                for col, v in zip(out, (id_, no, len(spans), node, first, last, a, b, text[a:b])):
                    col.append(v)
        i32, s = pa.int32(), pa.string()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (s, i32, i32, s, i32, i32, i32, i32, s))],
            ["id", "piece_no", "n_pieces", "node_type", "start_line", "end_line", "char_start", "char_end", "content"],
        )


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk whose content is longer than ``limit`` code points.

    Columns: see ``PIECES``. Rows repeated under one id with equal content are cut once; other contents
    of the same id are cut as well. A null or empty content gives no rows. Line numbers count from
    start_line; where it is null or below 1 they count from 1. Extra columns are ignored.
    """
    long = (
        chunks.select("id", "node_type", "content", "start_line")
        .filter(F.length("content") > limit)
        .groupBy("id", F.sha2("content", 256).alias("_s"))
        .agg(F.min(F.struct("start_line", "node_type", "content")).alias("_r"))
        .select("id", "_r.node_type", "_r.content", F.when(F.col("_r.start_line") >= 1, F.col("_r.start_line")).otherwise(1).cast("int").alias("line"))
    )
    return long.mapInArrow(lambda it: _pieces(it, limit, overlap), PIECES)


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ids that ``split_chunks`` had to cut."""
    return split_chunks(chunks, limit, overlap).filter(F.col("n_pieces") > 1).select("id").distinct()
