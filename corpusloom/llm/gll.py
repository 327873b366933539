"""A generalised LL recogniser with a graph-structured stack, over grammars written as text."""

from __future__ import annotations

import re
from collections.abc import Sequence

_DSL = re.compile(r"\s*(?:'((?:[^'\\]|\\.)+)'|([A-Za-z_]\w*)|(%\w+)|([=|;()?*+]))")


class Grammar:
    """Rules as a recursive transition network, with the actions of every state by the next token.

    The text holds rules ``Name = ... ;`` with alternatives ``|``, groups and ``? * +``. Quoted words and
    names without a rule are terminals. ``%ASI`` passes where a semicolon may be left out: before a line
    break, a closing brace or the end. Several start rules are dialects that are recognised together.

    Where a rule of ``memo`` is called, what it can make of the tokens ahead is kept by those tokens: source
    text repeats the shapes of its statements, and each shape is recognised once.
    """

    END = "<end>"

    #: Windows of remembered shapes, in tokens, and how many tokens all of them may hold together.
    LONGEST, MOST, DEEPEST = 160, 400_000, 120

    def __init__(self, text: str, starts: Sequence[str], memo: Sequence[str] = ()):
        tokens, at = [], 0
        while text[at:].strip():
            m = _DSL.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 40]!r}")
            tokens.append(next((k, v) for k, v in enumerate(m.groups()) if v is not None))
            at = m.end()
        self._trans: list[list[tuple[str, object, int]]] = []  # state -> (kind, what, to)
        self._rules: dict[str, tuple[int, int]] = {}
        self._tokens, self._at = tokens, 0
        while self._at < len(tokens):
            name = self._take()[1]
            self._take("=")
            a, b = self._alternatives()
            self._take(";")
            if name in self._rules:
                raise ValueError(f"grammar: {name} twice")
            self._rules[name] = (a, b)
        self.starts = list(starts)
        self._compile()
        self.memo = {self.rule_ids[m] for m in memo}
        self._shapes: dict[int, dict] = {m: {} for m in self.memo}
        self._held = 0

    def _take(self, want: str | None = None) -> tuple[int, str]:
        t = self._tokens[self._at]
        if want and t != (3, want):
            raise ValueError(f"grammar: {want} expected at {self._tokens[self._at - 3 : self._at + 3]}")
        self._at += 1
        return t

    def _state(self) -> int:
        self._trans.append([])
        return len(self._trans) - 1

    def _alternatives(self) -> tuple[int, int]:
        a, b = self._state(), self._state()
        while True:
            x, y = self._sequence()
            self._trans[a].append(("e", None, x))
            self._trans[y].append(("e", None, b))
            if self._at < len(self._tokens) and self._tokens[self._at] == (3, "|"):
                self._at += 1
                continue
            return a, b

    def _sequence(self) -> tuple[int, int]:
        a = b = self._state()
        while self._at < len(self._tokens) and self._tokens[self._at] not in ((3, "|"), (3, ";"), (3, ")")):
            kind, v = self._take()
            x = self._state()
            y = self._state()
            if (kind, v) == (3, "("):
                p, q = self._alternatives()
                self._take(")")
                self._trans[x].append(("e", None, p))
                self._trans[q].append(("e", None, y))
            elif kind == 2:
                self._trans[x].append(("a", v, y))
            else:
                self._trans[x].append(("t" if kind == 0 else "n", re.sub(r"\\(.)", r"\1", v), y))
            op = self._tokens[self._at][1] if self._at < len(self._tokens) and self._tokens[self._at][0] == 3 else ""
            if op in ("?", "*", "+"):
                self._at += 1
                if op in ("?", "*"):
                    self._trans[x].append(("e", None, y))
                if op in ("*", "+"):
                    self._trans[y].append(("e", None, x))
                p, q = self._state(), self._state()
                self._trans[p].append(("e", None, x))
                self._trans[y].append(("e", None, q))
                x, y = p, q
            self._trans[b].append(("e", None, x))
            b = y
        return a, b

    def _compile(self) -> None:
        trans, rules = self._trans, self._rules
        ends = {b: name for name, (_, b) in rules.items()}
        # terminals: names without a rule are token kinds; each also exists with a line break before it
        for row in trans:
            for i, (k, v, to) in enumerate(row):
                if k == "n" and v not in rules:
                    row[i] = ("t", v, to)
        words = sorted({v for row in trans for k, v, _ in row if k == "t"} | {self.END})
        self.kinds = {}
        for w in words:
            self.kinds[w] = len(self.kinds)
        self.plain = len(self.kinds)
        wide = 2 * self.plain
        both = lambda v: {self.kinds[v], self.kinds[v] + self.plain}
        asi = set(range(self.plain, wide)) | both(self.END) | (both("}") if "}" in self.kinds else set())
        n = len(trans)
        # nullable states (their rule's end can be reached over nothing) and first sets, to a fixed point
        null = [False] * n
        first: list[set] = [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for s in range(n - 1, -1, -1):
                f0, n0 = len(first[s]), null[s]
                if s in ends:
                    null[s] = True
                for k, v, to in trans[s]:
                    if k == "t":
                        first[s] |= both(v)
                    elif k == "n":
                        a = rules[v][0]
                        first[s] |= first[a]
                        if null[a]:
                            first[s] |= first[to]
                            null[s] |= null[to]
                    else:
                        first[s] |= first[to]
                        null[s] |= null[to]
                changed |= len(first[s]) != f0 or null[s] != n0
        follow: dict[str, set] = {name: set() for name in rules}
        for s in self.starts:
            follow[s] |= both(self.END)
        owner = {}
        for name, (a, _) in rules.items():
            stack = [a]
            while stack:
                s = stack.pop()
                if s in owner:
                    continue
                owner[s] = name
                stack += [to for _, _, to in trans[s]]
        changed = True
        while changed:
            changed = False
            for s in range(n):
                for k, v, to in trans[s]:
                    if k == "n" and s in owner:
                        add = first[to] | (follow[owner[s]] if null[to] else set())
                        if not add <= follow[v]:
                            follow[v] |= add
                            changed = True
        # closure over empty moves: for each state, its real actions; restricted by look-ahead
        self.rule_ids = {name: i for i, name in enumerate(rules)}

        def closure(s: int) -> dict[tuple, set]:
            out: dict[tuple, set] = {}
            seen: dict[int, set] = {}
            stack = [(s, set(range(wide)))]
            while stack:
                q, may = stack.pop()
                if q in seen and may <= seen[q]:
                    continue
                seen[q] = seen.get(q, set()) | may
                if q in ends:
                    out[("r",)] = out.get(("r",), set()) | (may & follow[ends[q]])
                for k, v, to in trans[q]:
                    if k == "e":
                        stack.append((to, may))
                    elif k == "a":
                        stack.append((to, may & asi))
                    elif k == "t":
                        out[("t", to)] = out.get(("t", to), set()) | (may & both(v))
                    else:
                        a = rules[v][0]
                        la = first[a] | ((first[to] | (follow[owner[q]] if null[to] else set())) if null[a] else set())
                        key = ("c", self.rule_ids[v], to)
                        out[key] = out.get(key, set()) | (may & la)
            return out

        need = {a for a, _ in rules.values()} | {to for row in trans for k, _, to in row if k in "tn"}
        self.table: list = [None] * n
        for s in need:
            row: list = [()] * wide
            for act, may in closure(s).items():
                for t in may:
                    row[t] = (*row[t], act)
            self.table[s] = row
        self._lone: dict[tuple, int] = {}
        self.begin = [0] * len(rules)
        for name, (a, _) in rules.items():
            self.begin[self.rule_ids[name]] = a
        del self._tokens

    def recognise(self, tokens: list[int]) -> int:
        """-1 if some dialect accepts the tokens, else the place of the furthest token reached.

        ``tokens`` are numbers of ``kinds``, with ``plain`` added after a line break.
        """
        tokens = [*tokens, self.kinds[self.END]]
        ends, furthest = self._run([self.rule_ids[s] for s in self.starts], tokens, 0, 0)
        return -1 if len(tokens) - 1 in ends else furthest

    def _ahead(self, rule: int, tokens: list[int], i: int, depth: int) -> tuple[list[int], int]:
        """Where a remembered rule may end from a place, and the furthest token looked at for that."""
        shape = self._shapes[rule]
        j = i
        while True:
            known = shape.get(-1)
            if known is not None:
                return [i + e for e in known], j - 1
            if j >= len(tokens):
                break
            shape = shape.get(tokens[j])
            if shape is None:
                break
            j += 1
        ends, furthest = self._run([rule], tokens, i, depth + 1)
        if furthest - i < self.LONGEST:
            if self._held > self.MOST:
                self._shapes = {m: {} for m in self.memo}
                self._held = 0
            shape = self._shapes[rule]
            for t in tokens[i : furthest + 1]:
                shape = shape.setdefault(t, {})
            shape[-1] = [e - i for e in ends]
            self._held += furthest + 1 - i
        return ends, furthest

    def _run(self, rules: list[int], tokens: list[int], begin_at: int, depth: int) -> tuple[list[int], int]:
        """All places where one of the rules may end from a place, and the furthest token looked at.

        A stack node is (rule, place): what called it and where it may end, each once, so that work is shared
        between all ways of reading a text. A node's first caller -1 is the outside.
        """
        table, begin, width = self.table, self.begin, len(self.begin)
        memo = self.memo if depth < self.DEEPEST else ()
        nodes: dict[int, tuple[list, list]] = {}
        outside: list[int] = []
        work: list[tuple] = []
        for r in rules:
            node = nodes[r + width * begin_at] = ([(-1, None)], [])
            work.append((begin[r], node, begin_at))
        forks = set()
        furthest = begin_at
        while work:
            s, node, i = work.pop()
            while True:
                if s < 0:
                    if i not in outside:
                        outside.append(i)
                    break
                if i > furthest:
                    furthest = i
                acts = table[s][tokens[i]]
                if not acts:
                    break
                if len(acts) > 1:
                    key = (s, id(node), i)
                    if key in forks:
                        break
                    forks.add(key)
                    for act in acts[1:]:
                        # other ways wait; each is taken up as a state of its own
                        work.append((self._single(act), node, i))
                act = acts[0]
                k = act[0]
                if k == "t":
                    s = act[1]
                    i += 1
                elif k == "c":
                    key = act[1] + width * i
                    to = nodes.get(key)
                    if to is None:
                        if act[1] in memo:
                            ends, far = self._ahead(act[1], tokens, i, depth)
                            if far > furthest:
                                furthest = far
                            nodes[key] = ([(act[2], node)], ends)
                            for e in ends:
                                work.append((act[2], node, e))
                            break
                        nodes[key] = to = ([(act[2], node)], [])
                        s, node = begin[act[1]], to
                        continue
                    if not any(a == act[2] and b is node for a, b in to[0]):
                        to[0].append((act[2], node))
                        for e in to[1]:
                            work.append((act[2], node, e))
                    break
                else:
                    ends = node[1]
                    if i in ends:
                        break
                    ends.append(i)
                    calls = node[0]
                    for c in calls[1:]:
                        work.append((c[0], c[1], i))
                    s, node = calls[0]
        return outside, furthest

    def _single(self, act: tuple) -> int:
        """A state whose only action, whatever the token, is the given one."""
        s = self._lone.get(act)
        if s is None:
            s = self._lone[act] = len(self.table)
            self.table.append([(act,)] * (2 * self.plain))
        return s
