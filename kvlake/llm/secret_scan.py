"""Secret scans by one combined deterministic automaton.

All rules' regular expressions become one non-deterministic automaton, read
backwards and unanchored, which subset construction and minimisation turn into one
transition array.  A single pass over the bytes of a text, from its end to its
start, then gives every position at which some match of some rule begins.  From the
leftmost of them the rule's own forward automaton (same construction) finds the
longest match, and the search goes on behind it: leftmost non-overlapping matches
per rule.  Only matches are read a second time.

The expressions are a small dialect: literals, classes, escapes \\xHH, groups,
alternatives, ?, *, + and {m}, {m,}, {m,n}; ``fold`` lets letters match either case.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns, free_names, map_text

ALL = frozenset(range(256))


@dataclass(frozen=True)
class Rule:
    """``head`` then ``body``; a match counts if it has ``min_total`` characters and its
    body ``min_body``.  A match that fails is passed over, as a whole."""

    kind: str
    head: str
    body: str
    min_total: int = 0
    min_body: int = 0
    fold: bool = False


# The base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", min_body=12, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]+", min_total=18),
    Rule("hex", "", "[0-9a-f]{16,}"),
)
# Public token formats, as their issuers document them.
FURTHER = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", min_body=36),
    Rule("gitlab", "glpat-", "[A-Za-z0-9_-]+", min_body=20),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", min_body=10),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]+", min_body=16),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", min_body=35),
    Rule("npm", "npm_", "[A-Za-z0-9]+", min_body=36),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", min_total=40),
    Rule("pem", "-----BEGIN ", "([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("bearer", "bearer\\x20+", "[A-Za-z0-9._~+/=-]+", min_body=20, fold=True),
    Rule("userinfo", "[a-z]+://[A-Za-z0-9._-]+:", "[A-Za-z0-9._~!$%-]+@", min_body=5),
)
RULES = BASE + FURTHER


class _Parser:
    """A regular expression as a tree of ("set", bytes), ("cat", ...), ("alt", ...), ("rep", node, low, high)."""

    def __init__(self, text: str, fold: bool):
        self.s, self.i, self.fold = text, 0, fold

    def parse(self):
        node = self.alt()
        if self.i < len(self.s):
            raise ValueError(f"unread: {self.s[self.i:]}")
        return node

    def alt(self):
        parts = [self.cat()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def cat(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeat())
        return ("cat", *parts)

    def repeat(self):
        node = self.atom()
        while self.i < len(self.s):
            c = self.s[self.i]
            if c in "?*+":
                self.i += 1
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            elif m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.s, self.i):
                self.i = m.end()
                node = ("rep", node, int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
            else:
                break
        return node

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found |= {b ^ 32 for b in found if 65 <= b <= 90 or 97 <= b <= 122}
        return frozenset(found)

    def atom(self):
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            node = self.alt()
            self.i += 1
            return node
        if c != "[":
            return ("set", self.cased({self.char()}))
        self.i += 1
        found: set[int] = set()
        while self.s[self.i] != "]":
            low = high = self.char()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                high = self.char()
            found |= set(range(low, high + 1))
        self.i += 1
        return ("set", self.cased(found))


def _backwards(node):
    if node[0] == "cat":
        return ("cat", *(_backwards(x) for x in reversed(node[1:])))
    if node[0] == "alt":
        return ("alt", *(_backwards(x) for x in node[1:]))
    return ("rep", _backwards(node[1]), *node[2:]) if node[0] == "rep" else node


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Builds ``node`` from ``start``; its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1:]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1:]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(x, own)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            hub = self.state()
            self.free[start].append(hub)
            self.free[self.add(inner, hub)].append(hub)
            return hub
        end = self.state()
        for _ in range(high - low):
            self.free[start].append(end)
            start = self.add(inner, start)
        self.free[start].append(end)
        return end


class Automaton:
    """Deterministic and minimal: ``table[256 * state + byte]`` is the next state, ``accepts[state]``
    a bit per expression; state 0 is the start."""

    def __init__(self, nodes: list, anchored: bool):
        nfa = _Nfa()
        start = nfa.state()
        ends: dict[int, int] = defaultdict(int)
        if not anchored:
            nfa.moves[start].append((ALL, start))
        for bit, node in enumerate(nodes):
            own = nfa.state()
            nfa.free[start].append(own)
            ends[nfa.add(node, own)] |= 1 << bit
        classes = self._classes(nfa)
        moves, accepts = self._subsets(nfa, start, ends, classes)
        moves, accepts = self._minimal(moves, accepts)
        self.accepts = accepts
        self.table = [moves[s][c] for s in range(len(moves)) for c in classes]

    @staticmethod
    def _classes(nfa: _Nfa) -> list[int]:
        """The class of each byte: bytes that no expression tells apart share one."""
        marks = [0] * 256
        for k, chars in enumerate({chars for moves in nfa.moves for chars, _ in moves}):
            for b in chars:
                marks[b] |= 1 << k
        numbers = {m: i for i, m in enumerate(sorted(set(marks)))}
        return [numbers[m] for m in marks]

    @staticmethod
    def _subsets(nfa: _Nfa, start: int, ends: dict[int, int], classes: list[int]):
        sample = {c: b for b, c in enumerate(classes)}
        width = len(sample)
        step = [[[t for chars, t in moves if sample[c] in chars] for c in range(width)] for moves in nfa.moves]

        def closed(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        first = closed([start])
        number, order, moves = {first: 0}, [first], []
        for subset in order:
            row = []
            for c in range(width):
                to = closed({t for s in subset for t in step[s][c]})
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            moves.append(row)
        accepts = [0] * len(order)
        for i, subset in enumerate(order):
            for s in subset:
                accepts[i] |= ends.get(s, 0)
        return moves, accepts

    @staticmethod
    def _minimal(moves: list[list[int]], accepts: list[int]):
        """Partition refinement; the block of the start comes first."""
        block = accepts
        count = 0
        while True:
            keys = [(block[s], *(block[t] for t in moves[s])) for s in range(len(moves))]
            numbers: dict = {}
            block = [numbers.setdefault(k, len(numbers)) for k in keys]
            if len(numbers) == count:
                break
            count = len(numbers)
        rows, marks = [[]] * count, [0] * count
        for s, b in enumerate(block):
            rows[b], marks[b] = [block[t] for t in moves[s]], accepts[s]
        return rows, marks


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [(_Parser(r.head, r.fold).parse(), _Parser(r.body, r.fold).parse()) for r in rules]
        combined = Automaton([_backwards(("cat", h, b)) for h, b in trees], anchored=False)
        # For the inner loop a state is its own row of 256 rows; one more entry tells what begins there.
        rows: list[list] = [[] for _ in combined.accepts]
        for s, row in enumerate(rows):
            row.extend(rows[t] for t in combined.table[256 * s : 256 * s + 256])
            row.append(combined.accepts[s])
        self.states, self.start = len(rows), rows[0]
        self.marked = {id(row): row[256] for row in rows if row[256]}
        self.forward = [Automaton([("cat", h, b)], anchored=True) for h, b in trees]
        self.heads = [Automaton([h], anchored=True) for h, _ in trees]

    @staticmethod
    def longest(automaton: Automaton, text: bytes, start: int) -> int:
        """The end of the longest match from ``start``, or -1."""
        table, accepts = automaton.table, automaton.accepts
        state, end = 0, start if accepts[0] else -1
        dead = len(accepts)
        for i in range(start, len(text)):
            to = table[256 * state + text[i]]
            if accepts[to]:
                end = i + 1
            elif to == state and dead and all(t == to for t in table[256 * to : 256 * to + 256]):
                break
            state = to
        return end

    def begins(self, text: bytes) -> dict[int, list[int]]:
        """By rule, where matches begin, in ascending order: the one pass over all bytes."""
        marked, row = self.marked, self.start
        found: list[tuple[int, int]] = []
        at = len(text)
        for b in reversed(text):
            at -= 1
            row = row[b]
            if row[256]:
                found.append((at, row[256]))
        out: dict[int, list[int]] = {}
        for at, mask in reversed(found):
            k = 0
            while mask:
                if mask & 1:
                    out.setdefault(k, []).append(at)
                mask >>= 1
                k += 1
        return out

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points, by start and rule."""
        found = []
        for k, starts in self.begins(text).items():
            rule, behind = self.rules[k], 0
            for s in starts:
                if s < behind:
                    continue
                end = self.longest(self.forward[k], text, s)
                if end < 0:
                    continue
                behind = max(end, s + 1)
                if end - s < rule.min_total:
                    continue
                if rule.min_body and end - self.longest(self.heads[k], text, s) < rule.min_body:
                    continue
                found.append((s, k, end))
        found.sort()
        if found and not text.isascii():
            at, n, points = 0, 0, {}
            for b in sorted({x for s, _, e in found for x in (s, e)}):
                n += len(text[at:b].decode("utf-8", "replace"))
                at, points[b] = b, n
            found = [(points[s], k, points[e]) for s, k, e in found]
        return found


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One automaton per process and set of rules."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans) of every row: kind, start and end in code points, by start and rule order.

    Null and empty texts have no spans; null ids and repeated rows are kept; other columns are ignored.
    """

    def rows(texts: list[bytes]) -> dict[str, list]:
        s = scanner(rules)
        return {"spans": [[{"kind": rules[k].kind, "start": a, "end": e} for a, k, e in s.spans(t)] for t in texts]}

    return map_text(docs, id_col, text_col, rows, {"spans": SPAN}, "spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; spans that overlap are replaced together."""

    def rows(texts: list[bytes]) -> dict[str, list]:
        s, out = scanner(rules), []
        for t in texts:
            spans = s.spans(t)
            if not spans:
                out.append(None)
                continue
            text, parts, at, k = t.decode("utf-8", "replace"), [], 0, 0
            while k < len(spans):
                start, rule, end = spans[k]
                while k + 1 < len(spans) and spans[k + 1][0] < end:
                    k += 1
                    end = max(end, spans[k][2])
                parts += [text[at:start], f"[{rules[rule].kind}]"]
                at, k = end, k + 1
            out.append("".join([*parts, text[at:]]))
        return {name: out}

    from pyspark.sql import functions as F

    [name] = free_names(docs, "__redacted")
    found = add_columns(docs, text_col, rows, {name: pa.string()}, f"`{name}` string")
    return found.withColumn(text_col, F.coalesce(name, text_col)).select(*docs.columns)
