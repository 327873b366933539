"""Evaluation texts inside training texts (problem 9) by the q-gram lemma over diagonal bands."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

WORDS, EDITS, Q = 10, 1, 8
ITEM_BYTES = 32 << 20

_RUN = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0001-\U000e007f]")


def normal(text: str) -> bytes:
    """The words of a text, in lower case, joined by single spaces and with one at either end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    return (" " + " ".join(_RUN.findall(text.lower())) + " ").encode("utf-8", "replace")


class ItemIndex:
    """The q-grams of all items of one block, with their places in the joined items."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, edits: int = EDITS):
        texts = [(i, normal(t)) for i, t in items]
        texts = [(i, t) for i, t in texts if t.count(b" ") > words]
        self.ids = [i for i, _ in texts]
        self.words, self.edits = words, edits
        shortest = 1 << 30
        for _, t in texts:
            gap = np.flatnonzero(np.frombuffer(t, np.uint8) == 32)
            shortest = min(shortest, int((gap[words:] - gap[:-words]).min()) + 1)
        #: q-grams in the shortest passage, and how many of them the budget of edits leaves
        self.window = max(1, shortest - Q + 1) if texts else 1
        self.least = max(1, self.window - Q * edits)
        self.data = b"".join(t + b"\x02" * Q for _, t in texts) + b"\x02" * Q
        self.starts = np.cumsum([0] + [len(t) + Q for _, t in texts])
        self.array = np.frombuffer(self.data, np.uint8)
        grams = _grams(self.data)
        real = np.flatnonzero(~(np.convolve(self.array == 2, np.ones(Q, int), "valid") > 0)) if texts else np.zeros(0, np.int64)
        order = np.argsort(grams[real], kind="stable")
        self.place = real[order]
        self.gram, first = np.unique(grams[real][order], return_index=True)
        self.first = np.append(first, len(real))
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[_slot(self.gram, self.bits)] = True


def _grams(data: bytes) -> np.ndarray:
    """The Q bytes from every place, as one number."""
    n = len(data) - Q + 1
    out = np.empty(max(n, 0), np.uint64)
    for k in range(Q):
        part = out[k::Q]
        part[:] = np.frombuffer(data, "<u8", len(part), k)
    return out


def _slot(g: np.ndarray, bits: int) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _runs(eq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate(([0], eq.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _align(x: ItemIndex, doc: np.ndarray, item: int, diagonals: range) -> tuple[int, int, int, int] | None:
    """Banded alignment of an item with a document on a few neighbouring diagonals (place in the document
    less place in the item): (most consecutive words, bytes matched, edits, first byte in the document).

    The equal runs of every diagonal of the band are chained in item order; what lies between two runs
    counts as edits.
    """
    a0, b0 = int(x.starts[item]), int(x.starts[item + 1]) - Q
    runs = []
    for d in diagonals:
        lo, hi = max(0, -d), min(b0 - a0, len(doc) - d)
        if hi - lo < Q:
            continue
        mine = x.array[a0 + lo : a0 + hi]
        s, e = _runs(mine == doc[lo + d : hi + d])
        for i in np.flatnonzero(e - s >= Q):
            # whole words lie between the first and last space of the run
            words = int(np.count_nonzero(mine[s[i] : e[i]] == 32)) - 1
            runs.append((lo + int(s[i]), lo + int(e[i]), d, words))
    if not runs:
        return None
    runs.sort()
    best = max(r[3] for r in runs)
    matched = edits = 0
    at = since = None
    for s, e, d, _ in runs:
        if at is None:
            at, since, matched = (e, d), s + d, e - s
        elif e > at[0]:
            s = max(s, at[0])
            gap = max(s - at[0], abs(d - at[1]))
            if gap <= e - s:
                matched, edits, at = matched + e - s, edits + gap, (e, d)
    return best, matched, edits, since


def leaks_in(x: ItemIndex, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, words, bytes, edits) of the candidate regions of some normalised texts."""
    if not x.ids:
        return
    sep = b"\x01" * Q
    data = sep.join(texts) + sep
    starts = np.cumsum([0] + [len(t) + Q for t in texts])
    grams = _grams(data)
    hit = x.seen[_slot(grams, x.bits)]
    at = np.flatnonzero(hit)
    k = np.minimum(np.searchsorted(x.gram, grams[at]), len(x.gram) - 1)
    real = x.gram[k] == grams[at]
    at, k = at[real], k[real]
    hit = np.zeros(len(grams) + 1, np.int32)
    hit[at + 1] = 1
    c = np.cumsum(hit)
    w = min(x.window, len(grams))
    dense = c[w:] - c[:-w] >= x.least
    s, e = _runs(dense)
    found: dict[tuple[int, int], tuple] = {}
    array = np.frombuffer(data, np.uint8)
    for a, b in zip(s, e + w - 1):
        i0, i1 = np.searchsorted(at, (a, b))
        places, kk = at[i0:i1], k[i0:i1]
        many = x.first[kk + 1] - x.first[kk]
        total = int(many.sum())
        offset = np.repeat(x.first[kk] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(total)
        # diagonals in the joined items; bands of 2 * edits + 1 of them overlap at every diagonal
        diag = x.place[offset] - np.repeat(places - a, many)
        low = int(diag.min())
        n = np.bincount(diag - low)
        width = 2 * x.edits + 1
        cn = np.cumsum(np.concatenate((np.zeros(width, np.int64), n, np.zeros(width, np.int64))))
        band = cn[width:] - cn[:-width]
        good = np.flatnonzero(band >= x.least)
        if not len(good):
            continue
        item_of = np.searchsorted(x.starts, x.place[offset], "right") - 1
        # a region can begin in the end of one text and go on in the next: few matches may be missing
        within = range(int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b - 1, "right")))
        for g0, g1 in zip(*_runs_of(good)):
            # a band ending at place g holds the diagonals g - width + 1 .. g
            lo, hi = low + g0 - width + 1, low + g1
            on, times = np.unique(item_of[(diag >= lo) & (diag <= hi)], return_counts=True)
            for item in on[times >= x.least].tolist():
                for text in within:
                    shift = int(x.starts[item]) + int(a) - int(starts[text])
                    r = _align(x, array[starts[text] : starts[text] + len(texts[text])], item, range(shift - int(hi), shift - int(lo) + 1))
                    if r and r[:2] > found.get((text, item), (-1, -1))[:2]:
                        found[text, item] = r[:3]
    for (text, item), (words, size, edits) in found.items():
        yield text, item, words, size, edits


def _runs_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(v) > 1)
    return v[np.concatenate(([0], cut + 1))], v[np.concatenate((cut, [len(v) - 1]))]


LEAKS = "doc_id long, item_id long, words int, bytes int, edits int"


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, edits: int = EDITS) -> DataFrame:
    """(doc_id, item_id, words, bytes, edits): regions of documents that agree with an item but for few edits.

    ``words`` is the longest run of consecutive words of the item in the region, ``bytes`` how much of the
    item is matched, ``edits`` the changes between the matched parts. Only items of at least ``words``
    words can leak. Null and empty texts and items give no rows. Items are worked in blocks of at most
    ``ITEM_BYTES``, each sent to every executor; documents are never gathered.
    """
    spark = documents.sparkSession
    rows = [(r[0], r[1]) for r in items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator()]
    blocks, size = [[]], 0
    for r in rows:
        if blocks[-1] and size + len(r[1]) > ITEM_BYTES // 4:
            blocks.append([])
            size = 0
        blocks[-1].append(r)
        size += len(r[1])
    docs = spread(documents.select(F.col("doc_id").cast("long"), "text").filter("text is not null and text <> ''"))
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(ItemIndex(block, words, edits))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x = shared.value
            for b in batches:
                res: list[list] = [[] for _ in range(5)]
                ids, texts, held = [], [], 0

                def flush(ids=ids, texts=texts, res=res) -> None:
                    for t, item, *rest in leaks_in(x, texts):
                        for col, v in zip(res, (ids[t], x.ids[item], *rest)):
                            col.append(v)
                    ids.clear()
                    texts.clear()

                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    t = normal(text)
                    if len(t) >= x.window:
                        ids.append(doc)
                        texts.append(t)
                        held += len(t)
                    if held > 1 << 20:
                        flush()
                        held = 0
                if texts:
                    flush()
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(res, types)], ["doc_id", "item_id", "words", "bytes", "edits"])

        part = docs.mapInArrow(run, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out


def leaked(documents: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id): the document holds at least ``words`` consecutive words of the item."""
    return leaks(documents, items, words).filter(F.col("words") >= words).select("doc_id", "item_id").distinct()
