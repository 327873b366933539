"""Document and segment languages (problem 10) by prediction by partial matching."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

ORDER, SAMPLES, LEAST_WORDS = 3, 5000, 6

# ISO 639 codes and English names of the languages told apart.
NAMES = {
    "de": ("de", "deu", "ger", "german"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"),
    "it": ("it", "ita", "italian"),
    "pt": ("pt", "por", "portuguese"),
}

#: The letter under the accent, for the second byte 0x80..0xBF of a character after the byte 0xC3.
_BASE = "aaaaaaaceeeeiiiidnooooo.ouuuuy.s" * 2
_SYMBOLS = 32


def _classes() -> np.ndarray:
    """Byte to symbol: letters without case 1..26, space 0, apostrophe 27, accent mark 28, digits 29, rest 30."""
    c = np.full(256, 30, np.int64)
    for i in range(26):
        c[97 + i] = c[65 + i] = i + 1
    for b in b" \t\r\n":
        c[b] = 0
    c[ord("'")] = 27
    c[0xC3] = 28
    c[48:58] = 29
    for i, letter in enumerate(_BASE):
        c[0x80 + i] = 30 if letter == "." else ord(letter) - 96
    return c


CLASSES = _classes()


def _symbols(data: bytes) -> np.ndarray:
    return CLASSES[np.frombuffer(data, np.uint8)]


class ByteModel:
    """Context trees over the bytes of each language, frozen: the code length in bits of every symbol after
    every context of ``order`` symbols. A context gives its seen symbols count/(total + kinds) and escapes
    with kinds/(total + kinds) to the next shorter one; below the empty context all symbols are equal."""

    def __init__(self, samples: list[tuple[str, str]], order: int = ORDER):
        self.langs = sorted({a for a, _ in samples})
        self.order = order
        tables = []
        for lang in self.langs:
            text = " ".join(strip_code(t) for a, t in samples if a == lang)
            plain = text.translate(_PLAIN)
            data = _symbols((text + " " + plain if plain != text else text + " " + text).encode())
            p = np.full((1, _SYMBOLS), 1 / _SYMBOLS)
            for k in range(order + 1):
                at = np.zeros(max(0, len(data) - k), np.int64)
                for j in range(k + 1):
                    at = at * _SYMBOLS + data[j : len(data) - k + j]
                count = np.bincount(at, minlength=_SYMBOLS ** (k + 1)).reshape(-1, _SYMBOLS).astype(np.float64)
                total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
                lower = np.tile(p, (_SYMBOLS, 1)) if k else p
                known = total > 0
                p = np.where(known, np.where(count > 0, count, kinds * lower) / np.maximum(total + kinds, 1), lower)
            tables.append(-np.log2(p.reshape(-1)).astype(np.float32))
        self.bits = np.ascontiguousarray(np.stack(tables, 1)).astype(np.float16) if tables else np.zeros((_SYMBOLS ** (order + 1), 0), np.float16)

    def lengths(self, parts: list[bytes]) -> np.ndarray:
        """Code length in bits of each part under each language; a part begins after a space."""
        pad = b" " * self.order
        data = _symbols(b"".join(pad + p for p in parts))
        at = np.zeros(max(0, len(data) - self.order), np.int64)
        for j in range(self.order + 1):
            at = at * _SYMBOLS + data[j : len(data) - self.order + j]
        out = np.zeros((len(parts), len(self.langs)))
        pos = 0
        for i, p in enumerate(parts):
            if p:
                out[i] = self.bits[at[pos : pos + len(p)]].sum(0, dtype=np.float32)
            pos += len(p) + self.order
        return out


_PLAIN = str.maketrans({chr(0xC0 + i): (b if chr(0xC0 + i).islower() else b.upper()) for i, b in enumerate(_BASE) if b != "."})
_CODE = re.compile(r"`[^`\n]*`|https?://\S+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BREAK = re.compile(r"\n[ \t\r]*\n")
_LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d:\d\d|(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b)|\s*\S* ?\d\d:\d\d:\d\d\b|\s+at \S+\(|Traceback |\s*File \"|\$ |>>> ")
_CODE_LINE = re.compile(r"\s*(?:[})\]]|(?:import|from|return|def|class|func|fn|let|const|var|pub|use|if|for|while|export|async)\b.*[({=:;])")
_CONFIG_LINE = re.compile(r"\s*(?:\"?[\w.-]+\"?\s*[:=]\s*\S+,?\s*|[\w.-]+\s*=\s*.*)$")
_TAG = re.compile(r"<[^<>]+>")


def strip_code(text: str) -> str:
    """The text without quoted code, addresses and identifiers."""
    return _CODE.sub(" ", text)


def paragraphs(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, prose) of the paragraphs, which blank lines separate. Fenced and indented blocks, logs,
    headings and lines of code are not prose."""
    at, fenced = 0, False
    ends = [m.span() for m in _BREAK.finditer(text)] + [(len(text), len(text))]
    for a, b in ends:
        start, at = at, b
        part = text[start:a]
        lines = [x for x in part.split("\n") if x.strip()]
        if not lines:
            continue
        was = fenced
        marks = sum(x.lstrip().startswith(("```", "~~~")) for x in lines)
        fenced ^= marks % 2 == 1
        yield start, a, not was and not marks and _is_prose(lines)


def _is_prose(lines: list[str]) -> bool:
    if all(x.startswith(("    ", "\t")) for x in lines):
        return False
    if len(lines) == 1 and lines[0].lstrip().startswith("#"):
        return False
    odd = sum(map(_is_code, lines))
    return 2 * odd <= len(lines) if len(lines) > 1 else not odd


_QUOTED = re.compile(r"`[^`\n]*`")


def _is_code(line: str) -> bool:
    if line.lstrip().startswith("<") and _TAG.match(line.lstrip()):  # what is left without tags, unless the tags hold but names and values
        line, tags = _TAG.subn(" ", line)
        if len(_WORD.findall(line)) < max(LEAST_WORDS, 2 * tags):
            return True
        line = line.strip()
    if len(line) > 400:  # longer than lines of code or logs are, unless data: few words
        return line.count(" ") * 25 < len(line)
    if _LOG.match(line) or _CONFIG_LINE.match(line):
        return True
    bare = _QUOTED.sub("", line) if "`" in line else line
    return bare.endswith((";", "{", "}")) or any(x in bare for x in (":=", "=>", "==", " = ")) or bool(_CODE_LINE.match(bare))


def _judge(model: ByteModel, text: str, least: int) -> list[tuple[int, int, int, float, int]]:
    """(start, end, language, confidence, bytes) of every prose paragraph with at least ``least`` words."""
    spans, parts = [], []
    for a, b, prose in paragraphs(text):
        if prose and len(_WORD.findall(text, a, b)) >= least:
            spans.append((a, b))
            parts.append(" ".join(strip_code(text[a:b]).split()).encode("utf-8", "replace"))
    if not spans or not model.langs:
        return []
    bits = model.lengths(parts)
    bits -= bits.min(1, keepdims=True)
    best = bits.argmin(1)
    conf = 1 / np.exp2(-bits / 4).sum(1)
    return [(a, b, int(k), float(c), len(p)) for (a, b), k, c, p in zip(spans, best, conf, parts)]


def fit(samples: DataFrame, order: int = ORDER, most: int = SAMPLES) -> ByteModel:
    """The model from labelled texts (lang, text), at most ``most`` of them, those with the least hashes."""
    rows = samples.select("lang", "text").filter("lang is not null and text is not null").orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(most).collect()
    return ByteModel([(r[0], r[1]) for r in rows], order)


SEGMENTS = "doc_id long, segment int, char_start int, char_end int, lang string, confidence double, bytes int"


def segments(documents: DataFrame, samples: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The language of every segment: a run of prose paragraphs of one language. See ``SEGMENTS``.

    Headings, code, logs and paragraphs of fewer than ``least`` words have no language of their own. The
    confidence is that of the paragraphs, weighted by length. Null and empty texts give no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(samples))  # its size depends on order and languages only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                merged: list[list] = []
                for a, e, k, c, n in _judge(m, text, least):
                    if merged and merged[-1][2] == k:
                        w = merged[-1]
                        w[1], w[3], w[4] = e, w[3] + c * n, w[4] + n
                    else:
                        merged.append([a, e, k, c * n, n])
                for i, (a, e, k, c, n) in enumerate(merged):
                    for col, v in zip(out, (doc, i, a, e, m.langs[k], c / max(n, 1), n)):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "segment", "char_start", "char_end", "lang", "confidence", "bytes"])

    texts = documents.select(F.col("doc_id").cast("long"), "text").filter("text is not null and text <> ''")
    return spread(texts).mapInArrow(run, SEGMENTS)


def named(label, lang):
    """Whether the label column names the language column: by code, with or without region, or English name."""
    head = F.regexp_extract(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"^([a-z]+)(?:[-_].*)?$", 1)
    hit = F.lit(False)
    for code, forms in NAMES.items():
        hit = hit | ((lang == code) & head.isin(*forms))
    return hit


def document_languages(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """One row for each document: its label, the language with most prose, a confidence, whether the label
    names it, and how many languages its segments have. Without prose lang is null and confidence 0."""
    per = segments(documents, samples).groupBy("doc_id", "lang").agg(F.sum("bytes").alias("n"), F.sum(F.col("bytes") * F.col("confidence")).alias("c"))
    top = per.groupBy("doc_id").agg(F.max(F.struct("n", "lang", "c")).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).cast("int").alias("languages"))
    got = top.select("doc_id", F.col("m.lang").alias("lang"), (F.col("m.c") / F.greatest(F.col("all"), F.lit(1))).alias("confidence"), "languages")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label"))
    out = docs.join(got, "doc_id", "left")
    return out.select("doc_id", "label", "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("languages", F.lit(0)).alias("languages"), F.when(F.col("lang").isNotNull(), named(F.col("label"), F.col("lang"))).alias("label_ok"))


def mislabelled(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, lang): languages of prose paragraphs that the document's label does not name."""
    per = segments(documents, samples).select("doc_id", "lang").distinct()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label"))
    return per.join(docs, "doc_id").filter(~named(F.col("label"), F.col("lang"))).select("doc_id", "lang").distinct()
