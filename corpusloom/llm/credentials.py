"""Credentials in source text (problem 7): literals segmented into dictionary words by Viterbi."""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Residual characters from which a literal counts as random: beside a credential's name, and beside any name.
NEAR, FAR = 3, 14

# Words in the names of credentials; alone or as the last part of a name they are strong
# evidence, "token" and "key" only after one of QUALIFIERS or in a name of capitals.
STRONG = ("password", "passwd", "passphrase", "passcode", "pwd", "pass", "secret", "credential", "credentials", "apikey", "authtoken", "auth", "authorization")
WEAK = ("token", "key")
QUALIFIERS = ("api", "auth", "access", "secret", "private", "signing", "encryption", "client", "service", "bearer", "session", "refresh", "deploy", "master", "account", "shared", "license", "bot", "webhook", "ssh", "host", "app")

# Published formats of issued keys.
FORMATS = (
    r"A(?:KIA|SIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{16,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"(?:sk|rk)_live_[A-Za-z0-9]{10,}",
    r"xox[abeprs]-[A-Za-z0-9-]{10,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"npm_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_-]{40,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?",
)

# Words that stand for a value to be filled in.
FILLERS = ("changeme", "change-me", "change_me", "placeholder", "example", "dummy", "redacted", "replace", "replaceme", "your", "todo", "fixme", "xxxx", "sample", "insert", "notset", "not-set", "from-env", "from-environment", "none", "null", "undefined", "empty", "secret", "password", "passwd", "token", "fake", "test", "foobar", "hunter2")

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_BREAK = re.compile(r"\r?\n|(?:\\[rn])+")
_KEY_LINE = re.compile(r"[\s\"'`#/*|>+.,-]*?(=?[A-Za-z0-9+/]+={0,2})([\s\"'`#+.,;)\]}\\-]*)")
_KEY_GLUE = re.compile(r"[\s\"'`#/*|>+.,\\-]*|[\s\"'`#/*|>-]*[A-Z][A-Za-z-]+: [^;{}]*")
_FORMAT = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(FORMATS) + r")")
_URL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]{1,20}://([^\s:/@\"'`<>]*):([^\s/\"'`]+?)@([^\s/\"'`:]+)")
_DSN = re.compile(r"(?i)(?<=[;\s\"'`])(?:password|pwd)\s*=\s*([^;\"'`\n]+)")
_USER = re.compile(r"(?:\s-u|--user|--proxy-user)[ =]+[\"']?([^\s:\"']+):([^\s\"']+)")
_AUTH = re.compile(r"(?i)\b(bearer|basic|token)\s+([A-Za-z0-9+/=_.~-]{8,})")
_KEYWORD = re.compile(r"pass(?:w(?:or)?d|phrase|code)?|pwd|secret|token|credentials?|key|auth(?:orization)?")
_AFTER = re.compile(r"[\"'`\])]{0,3}\s*(?::\s*(?:&\s*(?:'static\s+)?str|[sS]tring|str|char\s*\*)\s*=|:=|=>|=(?!=)|:(?!:)|,|\()\s*")
_QUOTE = re.compile(r"(?:concat!\(\s*|\(\s*|[rbuf@]{0,2}#{0,3})?(\"\"\"|'''|[\"'`])")
_PLAIN = re.compile(r"([^\s\"'`(){}\[\];,<>\\]+)(?=[\s#;,<]|$)")
_TAG = re.compile(r"<([\w.:-]+)>([^<>\n]+)</\1>")
_LOGIN = re.compile(r"\blogin\s+\S+\s+password\s+(\S+)")
_FLAG = re.compile(r"--(?:[\w-]+-)?(?:password|passwd|pass|pwd|secret|token|api-?key|key)[ =][\"']?([^\s\"'`]+)")
#: A login said in words, as in comments and notes: whose it is, then a separator and the value.
_SAID = re.compile(
    r"(?i)\b(?:log(?:s|ged|ging)?[ -]?(?:in|on)|sign(?:s|ed)?[ -]?in|accounts?|admin(?:istrator)?|root|credentials?|user(?:name)?)\b(?:[ \t]+(?:is|are|as|with|use|user|for|the|name|account|details))*[ \t]*[:=]?[ \t]+"
    r"[\w.@+-]+(?:[ \t]*[/:|][ \t]*|[ \t]+(?:with|and|using|by|pw|pass(?:word)?)[ \t]+)(?:(?:the[ \t]+)?pass(?:word|phrase|code)?[ \t]*[:=]?[ \t]*)?[\"'`]?([^\s\"'`]{6,})"
)
_SAID_IN = ("log", "sign", "account", "admin", "root", "credential", "user")
_JOINT = re.compile(r"([\"'`])#{0,3}[ \t]*(?:\+|\.|,|\\)?[ \t]*\n\s*(?:\+|\.)?[ \t]*[\"'`]")
_JOIN = re.compile(r"#{0,3}\s*(?:\+|\.|,|\\)?\s*(?:\n\s*)?(?:\+|\.)?\s*([\"'`])")
_HASH = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|sha(?:1|256|384|512)[-:]|\$(?:2[aby]|argon2|5|6)\$|md5:")
_REFERENCE = re.compile(r"\$\{|\$\(|\$[A-Za-z_]|\{\{|%\(|%[A-Z_]+%|<[^>]*>|\{[a-z_.]*\}|(?:env|vault|secret|ref|file|ssm|arn|keyring|keychain)[:(]|process\.env|getenv|environ|^(?:\.{0,2}/|~/|[A-Z]:\\)|^@")


class Words:
    """A dictionary with bit costs: the words of a public vocabulary file, most frequent first."""

    def __init__(self, path: str = VOCABULARY):
        self.cost: dict[str, float] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                w = base64.b64decode(token)
                if w[:1] == b" " and len(w) > 3 and w[1:].isalpha() and w.isascii():
                    self.cost.setdefault(w[1:].decode().lower(), math.log2(int(rank) + 50))
        self.longest = max(map(len, self.cost))

    def residual(self, text: str) -> int:
        """Characters outside words in the cheapest segmentation, separators apart."""
        t = text.lower()
        n = len(t)
        best = [(0.0, 0)] + [(math.inf, 0)] * n
        for i in range(n):
            c, r = best[i]
            free = t[i] in " _-./:"
            one = (c + (1.0 if free else 6.0), r + (not free))
            if one < best[i + 1]:
                best[i + 1] = one
            if t[i].isalpha():
                for j in range(i + 3, min(n, i + self.longest) + 1):
                    w = self.cost.get(t[i:j])
                    if w is not None and (c + w, r) < best[j]:
                        best[j] = (c + w, r)
        return best[n][1]


def _filler(value: str) -> bool:
    """Whether a value stands for another: a filler, a reference to elsewhere, or one character repeated."""
    v = value.strip()
    low = v.lower().strip("<>[]{}*_-. ")
    if len(v) < 4 or len(set(v)) <= 2 or _REFERENCE.search(v):
        return True
    if low in FILLERS or re.match(r"(?:your|my|the|insert|enter|replace|example|changeme|dummy|placeholder|xxx|some)(?:[ _-]|$)", low):
        return True
    return bool(re.search(r"(?:example|placeholder|changeme|redacted|dummy|x{6,}|\*{4,}|\.{3})", low)) and not re.search(r"://", v)


def _name_before(text: str, end: int) -> str:
    a = end
    while a and (text[a - 1].isalnum() or text[a - 1] in "_-$"):
        a -= 1
    return text[a:end]


def _rank(name: str) -> int:
    """2: the name of a credential; 1: a name that may be one; 0: another."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    if not parts:
        return 0
    last, joined = parts[-1], "".join(parts)
    if last in STRONG or joined.endswith(("apikey", "authtoken", "accesskey", "privatekey", "signingkey", "secretkey")):
        return 2
    if last in WEAK:
        if len(parts) > 1 and parts[-2] in QUALIFIERS or name.isupper() and len(parts) > 1 or len(parts) == 1 and last == "token":
            return 2
        return 1
    return 0


def _literal(text: str, at: int) -> tuple[list[tuple[int, int]], str] | None:
    """The string literal at a place, with those joined to it: (spans of the parts, value)."""
    m = _QUOTE.match(text, at)
    if not m:
        return None
    spans, value, q, a = [], [], m.group(1), m.end()
    while True:
        b = a
        while b < len(text) and not text.startswith(q, b):
            if text[b] == "\n" and len(q) == 1 and q != "`" and not value and b - a > 200:
                break
            if text[b] == "\n" and len(q) == 1 and q != "`" and "-----BEGIN" not in text[a:b]:
                break
            b += 2 if text[b] == "\\" and q != "`" else 1
        b = min(b, len(text))
        spans.append((a, b))
        value.append(text[a:b])
        if not text.startswith(q, b):
            break
        j = _JOIN.match(text, b + len(q))
        if not j:
            break
        glue = j.group(0)[:-1]
        listed = "," in glue and "concat!" not in text[max(0, at - 1) : at + 9]
        after = text.find(j.group(1), j.end())
        keyed = after < 0 or text[after + 1 : after + 8].lstrip().startswith((":", "=>"))
        if listed or not re.search(r"[+.,\\\n]", glue) or keyed and not re.search(r"[+.\\]", glue):
            break
        q, a = j.group(1), j.end()
    return spans, "".join(value)


def _key_end(text: str, at: int) -> int:
    """Where a key without an end mark ends, from the end of its first mark: after the last of the lines of base64
    that follow, in a literal, its parts or a comment too. The last line of the text may be cut anywhere."""
    end = at
    while at < len(text):
        b = _KEY_BREAK.search(text, at)
        line = text[at : b.start() if b else len(text)]
        m = _KEY_LINE.fullmatch(line)
        if m:
            if b and len(m.group(1)) < 40 and not re.search(r"[\d+/=]", m.group(1)):
                break  # a word
            end = at + m.end(1)
        elif not _KEY_GLUE.fullmatch(line):
            break
        if not b or m and re.search(r"[;)\]}]", m.group(2)):
            break
        at = b.end()
    return end


def find(text: str, words: Words) -> list[tuple[int, int]]:
    """Spans of the literal credential values of a text, in order; a value in parts has a span for each, under its first place."""
    found: dict[int, list[tuple[int, int]]] = {}

    def add(spans: list[tuple[int, int]]) -> None:
        at = spans[0][0]
        if at not in found or spans[-1][1] > found[at][-1][1]:
            found[at] = spans

    def line_of(at: int) -> str:
        return text[text.rfind("\n", 0, at) + 1 : (text.find("\n", at) + 1 or len(text) + 1) - 1]

    def excused(at: int) -> bool:
        """The line says of itself that it shows no real value."""
        return bool(re.search(r"(?i)(?:#|//|--|/\*)\s*(?:placeholder|example|dummy|fake|sample|not a (?:real )?secret)\b", line_of(at)))

    lower = text.lower() if text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if "private key" in lower:
        for m in _PEM.finditer(text):
            e, following = _PEM_END.search(text, m.end()), _PEM.search(text, m.end())
            if e and following and following.start() < e.start():
                e = None  # the end of another block
            body = text[m.end() : e.start() if e else min(m.end() + 400, following.start() if following else len(text))]
            if e and (len(body) < 8000 or 2 * sum(map(len, re.findall(r"[A-Za-z0-9+/=]{16,}", body))) > len(body)):
                end = e.end()
            else:  # no end, or code that names both marks far apart
                end = _key_end(text, m.end())
            if len(re.findall(r"[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/]{8,}={1,2}", body)) and not _REFERENCE.search(body.strip()[:40]):
                add([(m.start(), end)])
    if "_" in text or "AKIA" in text or "-" in text or "eyJ" in text:
        for m in _FORMAT.finditer(text):
            v = m.group(0)
            if "EXAMPLE" not in v and not excused(m.start()) and len(set(v)) > 6:
                if v[:3] == "eyJ" and not _jwt(v):
                    continue
                add([m.span()])
    if "://" in text:
        for m in _URL.finditer(text):
            v = m.group(2)
            if not _filler(v) and not excused(m.start()) and v.lower() != m.group(1).lower():
                add([m.span(2)])
    if "pwd" in lower or "password" in lower:
        for m in _DSN.finditer(text):
            if ";" in text[text.rfind("\n", 0, m.start()) + 1 : m.start()] and not _filler(m.group(1)) and not excused(m.start()):
                add([m.span(1)])
    if " -u" in text or "user" in lower:
        for m in _USER.finditer(text):
            if not _filler(m.group(2)) and not excused(m.start()):
                add([m.span(2)])
    if "bearer" in lower or "basic" in lower:
        for m in _AUTH.finditer(text):
            v = m.group(2)
            if m.group(1).lower() == "basic":
                try:
                    user, _, v2 = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode().partition(":")
                except (binascii.Error, ValueError):
                    continue
                if v2 and not _filler(v2) and not excused(m.start()):
                    add([m.span(2)])
            elif m.group(1).lower() == "bearer" and not _filler(v) and re.search(r"\d", v) and words.residual(v) >= 6 and not excused(m.start()):
                add([m.span(2)])
    at = 0
    for m in _KEYWORD.finditer(lower):
        if m.start() < at:
            continue
        k = m.end()
        if text[k : k + 1] in ("s", "_", "-") or text[k : k + 1].isalnum():
            continue
        a = _AFTER.match(text, k)
        if not a:
            continue
        name = _name_before(text, k)
        rank = _rank(name)
        if not rank:
            continue
        op = a.group(0).strip(" \"'`])\n\t")
        if op in (",", "(") and (text[k : k + 1] not in "\"'`" or op == "("):
            continue
        lit = _literal(text, a.end())
        if lit:
            spans, v = lit
            if "-----BEGIN" in v or not v or excused(a.end()):
                continue
            if _secret(v, rank, words):
                lead = re.match(r"(?i)(?:bearer|basic|token)\s+", v)
                if lead and len(spans[0]) and lead.end() < spans[0][1] - spans[0][0]:
                    spans = [(spans[0][0] + lead.end(), spans[0][1]), *spans[1:]]
                if not any(spans[0][0] <= f < spans[-1][1] for f in found):
                    add(spans)
        elif op in ("=", ":", ":=") and "\n" not in a.group(0) and rank == 2:
            p = _PLAIN.match(text, a.end())
            v = p.group(1).rstrip(".") if p else ""
            if re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and not excused(k) and _secret(v, rank, words):
                if not any(p.start(1) <= f < p.end(1) for f in found):
                    add([(p.start(1), p.start(1) + len(v))])
    for pattern, group in ((_TAG, 2), (_LOGIN, 1), (_FLAG, 1)):
        if {_TAG: "</", _LOGIN: "login", _FLAG: "--"}[pattern] not in text:
            continue
        for m in pattern.finditer(text):
            if pattern is _TAG and _rank(m.group(1)) < 2:
                continue
            if _secret(m.group(group), 2, words) and not excused(m.start()) and not any(m.start() <= f < m.end() for f in found):
                add([m.span(group)])
    if any(w in lower for w in _SAID_IN):
        for m in _SAID.finditer(text):
            v = m.group(1).rstrip(".,;:)]}>")
            if _secret(v, 2, words) and not excused(m.start()) and not any(m.start(1) <= f < m.end(1) for f in found):
                add([(m.start(1), m.start(1) + len(v))])
    done = 0
    for m in _JOINT.finditer(text):
        start = text.rfind(m.group(1), text.rfind("\n", 0, m.start()) + 1, m.start())
        lit = _literal(text, start) if start >= done else None
        if not lit or len(lit[0]) < 2:
            continue
        spans, v = lit
        shown = excused(start)
        if len(spans) > 40 and not shown:  # one of many parts is judged once, not again from each of them
            done = spans[-1][1]
        hit = _inside(v, words)
        if hit is None or shown:
            continue
        first = next(i for i, (x, y) in enumerate(spans) if hit < sum(q - p for p, q in spans[: i + 1]))
        within = sorted(f for f in found if spans[first][0] <= f < spans[-1][1])
        if not within:
            add(spans[first:])
        elif within[0] < spans[first][1]:  # its first part alone was taken for the whole
            for f in within:
                del found[f]
            add([(within[0], spans[first][1]), *spans[first + 1 :]])
    out = []
    taken = -1
    for at in sorted(found):
        if at >= taken:
            out.append(found[at])
            taken = found[at][-1][1]
    return out


def _inside(value: str, words: Words) -> int | None:
    """Where a credential of a known form begins in a literal that was joined from parts."""
    m = _FORMAT.search(value)
    if m and "EXAMPLE" not in m.group(0):
        return m.start()
    m = _URL.search(value)
    if m and not _filler(m.group(2)):
        return m.start()
    m = _DSN.search(value)
    if m and not _filler(m.group(1)):
        return 0
    m = _AUTH.search(value)
    if m and m.group(1).lower() == "bearer" and not _filler(m.group(2)) and words.residual(m.group(2)) >= 6:
        return m.start()
    return None


def _jwt(v: str) -> bool:
    try:
        return b"alg" in base64.urlsafe_b64decode(v.split(".")[0] + "==")
    except (binascii.Error, ValueError):
        return False


def _secret(value: str, rank: int, words: Words) -> bool:
    """Whether a literal beside a name of this rank is a credential: not a filler, and enough of it is left
    unexplained by words; known formats of hashes only beside the name of a credential."""
    v = re.sub(r"(?i)^(?:bearer|basic|token)\s+", "", value.strip())
    if _filler(v) or re.search(r"\s", v):
        return False
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", v):
        return False  # an address; a password in it is found by itself
    if v.startswith(("-----BEGIN", "ssh-rsa ", "ssh-ed25519 ")):
        return False
    residual = words.residual(v)
    digits, letters = bool(re.search(r"\d", v)), bool(re.search(r"[A-Za-z]", v))
    if rank == 2:
        if not letters:
            return False
        return residual >= NEAR and (digits or bool(re.search(r"[^\w\s.-]", v)) or residual >= 6) or digits and bool(re.search(r"[^\w.]", v))
    if _HASH.match(v):
        return False
    return residual >= FAR and digits and letters and bool(re.search(r"[a-z]", v) and re.search(r"[A-Z]", v))


def mask(text: str, found: list[list[tuple[int, int]]]) -> str:
    """The text with the values replaced by asterisks, line ends and all else kept."""
    out, at = [], 0
    for spans in found:
        for a, b in spans:
            out.append(text[at:a])
            out.append(re.sub(r"[^\r\n]", "*", text[a:b]))
            at = b
    return "".join(out) + text[at:]


_loaded: dict[str, Words] = {}


def _scan(table: DataFrame, src: str, vocabulary: str, redact: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = Words(vocabulary)
        words = _loaded[vocabulary]
        for b in batches:
            ids, lines, texts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = find(t, words)
                if redact:
                    if f:
                        ids.append(i)
                        lines.append(len(f))
                        texts.append(mask(t, f))
                    continue
                for spans in f:
                    ids.append(i)
                    lines.append(t.count("\n", 0, spans[0][0]) + 1)
            cols = [pa.array([src] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(lines, pa.int32())]
            if redact:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], ["src", "id", "found", "content"])
            else:
                yield pa.RecordBatch.from_arrays(cols, ["src", "id", "line_no"])

    schema = "src string, id string, found int, content string" if redact else "src string, id string, line_no int"
    return spread(table.select("id", "content").filter("id is not null and content is not null and content <> ''")).mapInArrow(run, schema)


def lines(tables: dict[str, DataFrame], vocabulary: str = VOCABULARY) -> DataFrame:
    """(src, id, line_no), each once: the lines of content on which a literal credential begins, over all
    tables given by name. Null and empty contents and null ids give no rows; rows repeated under an id count once."""
    out = None
    for src, t in tables.items():
        part = _scan(t, src, vocabulary, False)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def redacted(tables: dict[str, DataFrame], vocabulary: str = VOCABULARY) -> DataFrame:
    """(src, id, found, content): the content of every row with credentials, their values masked by asterisks
    of equal length and everything else intact. Rows without any are not repeated here."""
    out = None
    for src, t in tables.items():
        part = _scan(t, src, vocabulary, True)
        out = part if out is None else out.unionByName(part)
    return out
