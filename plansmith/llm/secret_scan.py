"""Secret scans by one combined deterministic automaton over bytes.

Rules are regexes over ASCII classes. Their syntax trees become one non-deterministic automaton that may begin a match at
any byte; subset construction over byte classes makes it deterministic, partition refinement minimises it, and the result
is one flat transition array. Each text is read once, one array look-up a byte, whatever the number of rules. For a rule that
accepts anywhere, the rule's reversed automaton reads back from where it last accepted and marks every byte that a match
begins at; the leftmost mark behind the rule's last span begins the next, which the rule's own (anchored) automaton extends to
its longest end. So time is linear in the text. Spans of a rule never overlap; spans that are shorter than their rule asks for
are dropped after they have consumed their text.

Rules must be such that the longest match from a start is the one that a backtracking matcher would find (greedy parts
that can't give up characters to the next part): so are those below.

Defined results: null and empty texts have no spans; offsets are code points of the whole text, end exclusive; repeated
rows each get their result; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, read, ship


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    base: bool = True
    any_case: bool = False
    total: int = 0  # the least length of a span
    value: int = 0  # the least length of what follows the separator


#: The base rules, and kinds that the method adds. Only hex, which begins with nothing rarer, counts in the automaton
#: (its shorter matches are whole runs, so that leaving them out hides nothing); the others' lengths are looked at after
#: the match, since counters of several rules that run side by side would multiply the states.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", any_case=True, value=6),
    Rule("access", r"AKIA[A-Z0-9]+", total=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", base=False),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]+", base=False, total=20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", base=False, total=30),
)


class _Nfa:
    """Thompson's construction for classes, groups, |, ?, *, + and {n,}."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1

    def build(self, pattern: str, any_case: bool) -> tuple[int, int]:
        self.p, self.i, self.any_case = pattern, 0, any_case
        got = self.alternatives()
        if self.i != len(pattern):
            raise ValueError(f"unbalanced pattern {pattern!r}")
        return got

    def turn(self) -> None:
        """Reverses all edges. No state has two edges over bytes that lead to it."""
        eps: list[list[int]] = [[] for _ in self.eps]
        move: list[tuple[frozenset[int], int] | None] = [None] * len(self.move)
        for x, to in enumerate(self.eps):
            for y in to:
                eps[y].append(x)
        for x, m in enumerate(self.move):
            if m is not None:
                move[m[1]] = (m[0], x)
        self.eps, self.move = eps, move

    def alternatives(self) -> tuple[int, int]:
        branches = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        a, b = self.state(), self.state()
        for s, e in branches:
            self.eps[a].append(s)
            self.eps[e].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            s, e = self.repeated()
            self.eps[b].append(s)
            b = e
        return a, b

    def repeated(self) -> tuple[int, int]:
        start = self.i
        s, e = self.atom()
        c = self.p[self.i : self.i + 1]
        if c == "{":
            end = self.p.index("}", self.i)
            n = int(self.p[self.i + 1 : end].rstrip(","))
            parts = [(s, e)]
            for _ in range(n - 1):
                self.i = start
                parts.append(self.atom())
            for (_, x), (y, _) in zip(parts, parts[1:], strict=False):
                self.eps[x].append(y)
            if self.p[end - 1] == ",":
                self.eps[parts[-1][1]].append(parts[-1][0])
            self.i = end + 1
            return parts[0][0], parts[-1][1]
        if c and c in "?*+":
            self.i += 1
            a, b = self.state(), self.state()
            self.eps[a].append(s)
            self.eps[e].append(b)
            if c != "+":
                self.eps[a].append(b)
            if c != "?":
                self.eps[e].append(s)
            return a, b
        return s, e

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            got = self.alternatives()
            self.i += 1
            return got
        chars = self.char_class() if c == "[" else {self.char()}
        if self.any_case:
            chars = {y for x in chars for y in (ord(chr(x).lower()), ord(chr(x).upper()))}
        a, b = self.state(), self.state()
        self.move[a] = (frozenset(chars), b)
        return a, b

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def char_class(self) -> set[int]:
        self.i += 1
        chars: set[int] = set()
        while self.p[self.i] != "]":
            a = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                chars |= set(range(a, self.char() + 1))
            else:
                chars.add(a)
        self.i += 1
        return chars


@dataclass
class Dfa:
    table: list[int]  # state * 256 + byte: the next state times 256; accepting states come last, then none is dead but 0 of an anchored one
    accepting: int  # states from this one on, times 256, accept
    rules: dict[int, tuple[int, ...]]  # of accepting states
    start: int
    dead: int  # the state that no match leaves, or -1


def compile_rules(rules: tuple[Rule, ...], anchored: bool = False, backward: bool = False) -> Dfa:
    """backward: an automaton that reads texts from their end and accepts where a match begins."""
    nfa = _Nfa()
    starts, ends = [], {}
    for k, r in enumerate(rules):
        s, e = nfa.build(r.pattern, r.any_case)
        if backward:
            s, e = e, s
        starts.append(s)
        ends[e] = k
    if backward:
        nfa.turn()

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.move[x] is not None or x in ends)

    sets = list(dict.fromkeys(m[0] for m in nfa.move if m))
    kinds: dict[tuple[bool, ...], int] = {}
    byte_class = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(kinds))]
    first = closure(starts)
    again = frozenset() if anchored else first
    index, order, rows = {first: 0}, [first], []
    while len(rows) < len(order):
        row, cur = [], order[len(rows)]
        for b in sample:
            nxt = closure([nfa.move[x][1] for x in cur if nfa.move[x] and b in nfa.move[x][0]]) | again
            if nxt not in index:
                index[nxt] = len(order)
                order.append(nxt)
            row.append(index[nxt])
        rows.append(row)
    t = np.array(rows)
    accepts = [tuple(sorted(ends[x] for x in s if x in ends)) for s in order]
    labels = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    part = np.array([labels[a] for a in accepts])
    while True:  # refine until states of a part agree on where each byte class leads
        _, new = np.unique(np.column_stack((part, part[t])), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == part.max():
            break
        part = new
    n = part.max() + 1
    one = np.array([int(np.flatnonzero(part == p)[0]) for p in range(n)])
    rank = np.argsort(np.argsort([bool(accepts[x]) for x in one], kind="stable"), kind="stable")
    table = np.zeros((n, 256), np.int64)
    for p in range(n):
        table[rank[p]] = rank[part[t[one[p]]]][byte_class] * 256
    acc = {int(rank[p]) * 256: accepts[one[p]] for p in range(n) if accepts[one[p]]}
    dead = [int(rank[p]) * 256 for p in range(n) if not accepts[one[p]] and (table[rank[p]] == rank[p] * 256).all()]
    return Dfa(table.ravel().tolist(), min(acc), acc, int(rank[part[0]]) * 256, dead[0] if dead and anchored else -1)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_rules(rules)
        self.each = [compile_rules((r,), anchored=True) for r in rules]
        self.back = [compile_rules((r,), backward=True) for r in rules]

    def longest(self, k: int, data: bytes, at: int) -> int:
        """The end of rule k's longest match that begins at a byte, or -1."""
        d = self.each[k]
        t, s, end = d.table, d.start, -1
        for i in range(at, len(data)):
            s = t[s + data[i]]
            if s == d.dead:
                break
            if s >= d.accepting:
                end = i + 1
        return end

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes."""
        d = self.all
        t, least, s = d.table, d.accepting, d.start
        last: dict[int, int] = {}
        for i, b in enumerate(data):
            s = t[s + b]
            if s >= least:
                for k in d.rules[s]:
                    last[k] = i + 1
        found = []
        for k, end in last.items():
            upto = 0
            for p in self.starts(k, data, end):
                if p >= upto:
                    upto = self.longest(k, data, p)
                    if self.holds(k, data, p, upto):
                        found.append((p, upto, k))
        return sorted(found)

    def starts(self, k: int, data: bytes, end: int) -> list[int]:
        """The bytes that matches of rule k begin at, the last of which ends at end."""
        d = self.back[k]
        t, least, s = d.table, d.accepting, d.start
        out = []
        for i in range(end - 1, -1, -1):
            s = t[s + data[i]]
            if s >= least:
                out.append(i)
        return out[::-1]

    def holds(self, k: int, data: bytes, start: int, end: int) -> bool:
        r = self.rules[k]
        if end - start < r.total or not r.value:
            return end - start >= r.total
        # the separator is the first : or = behind the keyword, then blanks and one quote
        i = start
        while data[i] not in b":=":
            i += 1
        i += 1
        while data[i] == 32:
            i += 1
        if data[i] in b"\"'":
            i += 1
        return end - i >= r.value


def spans(text: str | None, scanner: Scanner) -> list[tuple[int, int, int]]:
    """(start, end, rule) in code points, by start and rule."""
    if not text:
        return []
    data = text.encode()
    got = scanner.scan(data)
    if not got or len(data) == len(text):
        return got
    before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), int(before[b]), k) for a, b, k in got]


_FOUND = "spans array<struct<kind:string,s:int,e:int,base:boolean>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and spans (kind, start, end, whether of a base rule)."""
    scanner = ship(docs.sparkSession, Scanner(rules))  # its size depends on the rules alone
    kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        sc = scanner()
        for b in pieces(batches):
            out = [[{"kind": sc.rules[k].kind, "s": s, "e": e, "base": sc.rules[k].base} for s, e, k in spans(t, sc)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(out, kind)], names=["doc_id", "text", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, text string, {_FOUND}")


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced together."""
    out, last = [], 0
    for s, e, kind in sorted(found):
        if s >= last:
            out += [text[last:s], f"<{kind}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def _joined(spans_: F.Column) -> F.Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _matches_sql(kind: str, pattern: str, keep: str) -> str:
    """Spans of one rule: texts are split at marks put round the matches, which then are every second piece."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, p[2 * i] AS m, CAST(list_sum(list_transform(p[1:2 * i - 1], lambda x: length(x))) AS BIGINT) AS s
  FROM (SELECT doc_id, p, unnest(generate_series(1, len(p) // 2)) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(text, '{quoted}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE regexp_matches(text, '{quoted}')))) WHERE {keep}"""


_ASSIGN_SQL = "(?i)" + RULES[0].pattern
_SPANS_SQL = " UNION ALL ".join(
    _matches_sql(r.kind, _ASSIGN_SQL if r.any_case else r.pattern, f"""length(regexp_replace(m, '^[^:=]*[:=] *["'']?', '')) >= {r.value}""" if r.value else f"length(m) >= {r.total}") for r in RULES
)
ORACLE_SQL = {
    "op9_secrets": f"""
WITH m AS ({_SPANS_SQL}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, e, list_position({[r.kind for r in RULES]}, kind)) AS spans,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, e, list_position({[r.kind for r in RULES]}, kind)) FILTER (kind IN {tuple(r.kind for r in RULES if r.base)}) AS base FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)"""
}
