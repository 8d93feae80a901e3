"""Secret scans by one combined deterministic automaton over bytes.

Each rule is a pattern followed by a greedy run: ``prefix`` then at least one byte of ``run``. A rule's
pattern becomes an automaton of sets of positions (subset construction) that looks for the leftmost
match, takes its run to the end and then looks on; the rules' automata are multiplied into one, which is
minimised into transition arrays. A text is read once, byte by byte, for all rules together; a few steps
back from the run's first byte give the match's start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import utf8

Bytes = frozenset  # of byte values


def chars(text: str, fold: bool = False) -> Bytes:
    """The bytes of a class written as in a pattern: single characters and ranges, nothing escaped but by ``\\``."""
    found, i = set(), 0
    while i < len(text):
        i += text[i] == "\\"
        if text[i + 1 : i + 2] == "-" and i + 2 < len(text):
            found |= set(range(ord(text[i]), ord(text[i + 2]) + 1))
            i += 3
        else:
            found.add(ord(text[i]))
            i += 1
    return frozenset(found | {b ^ 32 for b in found if chr(b).isalpha()} if fold else found)


@dataclass(frozen=True)
class Rule:
    """prefix: literals, ``[...]``, ``(a|b)`` and the signs ``?`` and ``*``; fold: its letters in either case. least: bytes of the run."""

    kind: str
    prefix: str
    run: str
    least: int
    fold: bool = False
    base: bool = True

    @property
    def counted(self) -> int:
        """Bytes of a run that the automaton counts; beyond, its length is known from its ends. Runs after a prefix are rare."""
        return 1 if self.prefix else min(self.least, 8)


#: In the order that spans of equal start are listed in.
RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", "A-Za-z0-9+/_.=\\-", 12, fold=True),
    Rule("access", "AKIA", "A-Z0-9", 14),
    Rule("hex", "", "0-9a-f", 16),
    Rule("forge", "gh(p|o|u|s|r)_", "A-Za-z0-9", 36, base=False),
    Rule("chat", "xox(a|b|p|r|s)-", "A-Za-z0-9\\-", 10, base=False),
    Rule("cloud", "AIza", "A-Za-z0-9_\\-", 35, base=False),
    Rule("jwt", "eyJ", "A-Za-z0-9_.\\-", 40, base=False),
    Rule("key", "-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", "A-Za-z0-9+/=\n\r", 32, base=False),
)


class Positions:
    """A prefix as positions with byte classes and what may follow each (after Glushkov)."""

    def __init__(self, rule: Rule):
        self.classes: list[Bytes] = []
        self.follow: list[set[int]] = []
        self.fold, self.text, self.at = rule.fold, rule.prefix, 0
        first, last, empty = self._either()
        self.run = self._new(chars(rule.run))
        self.first = first | ({self.run} if empty else set())
        for p in last:
            self.follow[p].add(self.run)
        self.follow[self.run].add(self.run)

    def _new(self, of: Bytes) -> int:
        self.classes.append(of)
        self.follow.append(set())
        return len(self.classes) - 1

    def _either(self) -> tuple[set, set, bool]:
        first, last, empty = self._row()
        while self.text[self.at : self.at + 1] == "|":
            self.at += 1
            f, l, e = self._row()
            first, last, empty = first | f, last | l, empty or e
        return first, last, empty

    def _row(self) -> tuple[set, set, bool]:
        first, last, empty = set(), set(), True
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            f, l, e = self._item()
            for p in last:
                self.follow[p] |= f
            first, last, empty = first | f if empty else first, last | l if e else l, empty and e
        return first, last, empty

    def _item(self) -> tuple[set, set, bool]:
        sign = self.text[self.at]
        if sign == "(":
            self.at += 1
            first, last, empty = self._either()
            self.at += 1
        else:
            end = self.text.index("]", self.at) if sign == "[" else self.at
            p = self._new(chars(self.text[self.at + 1 : end] if sign == "[" else sign, self.fold))
            self.at = end + 1
            first, last, empty = {p}, {p}, False
        if self.text[self.at : self.at + 1] in ("?", "*") and self.at < len(self.text):
            if self.text[self.at] == "*":
                for p in last:
                    self.follow[p] |= first
            self.at += 1
            empty = True
        return first, last, empty


class Searcher:
    """One rule's automaton. A state: the positions read last, or the run's length so far, as far as it is counted."""

    def __init__(self, rule: Rule):
        self.rule, self.p = rule, Positions(rule)

    def start(self) -> frozenset:
        return frozenset()

    def step(self, state, byte: int):
        p = self.p
        if isinstance(state, int):  # in the run: nothing else counts until it ends
            if byte in p.classes[p.run]:
                return min(state + 1, self.rule.counted)
            state = frozenset()
        after = {q for x in state for q in p.follow[x]} | p.first
        now = frozenset(q for q in after if byte in p.classes[q])
        return 1 if p.run in now else now

    def full(self, state) -> bool:
        return state == self.rule.counted


def minimised(rows: list[list[int]], marks: list[int]) -> tuple[list[list[int]], list[int], int]:
    """Moore's refinement: states with equal marks and equal futures become one. State 0 stays the first."""
    group = marks
    while True:
        ids: dict[tuple, int] = {}
        new = [ids.setdefault((group[s], *(group[t] for t in rows[s])), len(ids)) for s in range(len(rows))]
        if len(ids) == len(set(group)):
            break
        group = new
    pick = {g: s for s, g in reversed(list(enumerate(new)))}
    return [[new[t] for t in rows[pick[g]]] for g in range(len(pick))], [marks[pick[g]] for g in range(len(pick))], new[0]


@dataclass
class Automaton:
    """rules; next: for each state, the next one by byte; marks: the rules, as bits, that are in a run here."""

    rules: tuple[Rule, ...]
    next: list[list[int]] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, rules: tuple[Rule, ...]) -> Automaton:
        each = [Searcher(r) for r in rules]
        # Bytes that no class tells apart move alike.
        sorts: dict[tuple, int] = {}
        sort = [sorts.setdefault(tuple(b in c for s in each for c in s.p.classes), len(sorts)) for b in range(256)]
        sample = [sort.index(k) for k in range(len(sorts))]
        ids = {tuple(s.start() for s in each): 0}
        rows: list[list[int]] = []
        todo, known = list(ids), [dict() for _ in each]
        while todo:
            state = todo.pop(0)
            row = []
            for k, b in enumerate(sample):
                to = []
                for s, x, memo in zip(each, state, known, strict=True):
                    if (x, k) not in memo:
                        memo[x, k] = s.step(x, b)
                    to.append(memo[x, k])
                to = tuple(to)
                if to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append(ids[to])
            rows.append(row)
        marks = [sum(s.full(x) << k for k, (s, x) in enumerate(zip(each, state, strict=True))) for state in ids]
        rows, marks, first = minimised(rows, marks)
        # Numbered so that 0 is the start and all states with a mark come last; then one comparison tells them.
        order = sorted(range(len(rows)), key=lambda s: (bool(marks[s]), s != first))
        name = {s: i for i, s in enumerate(order)}
        return cls(rules, [[name[rows[s][sort[b]]] for b in range(256)] for s in order], [marks[s] for s in order])

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches, in bytes."""
        rows, bound = self.next, next((s for s, m in enumerate(self.marks) if m), len(self.marks))
        row, found, at, live = rows[0], [], -1, 0
        since: dict[int, int] = {}
        for at, byte in enumerate(data):
            state = row[byte]
            row = rows[state]
            if state >= bound or live:
                now = self.marks[state]
                if now != live:
                    for k in range(len(self.rules)):
                        if now >> k & 1 and not live >> k & 1:
                            since[k] = at - self.rules[k].counted + 1
                        elif live >> k & 1 and not now >> k & 1:
                            found.append((k, since.pop(k), at))
                    live = now
        found += [(k, run, at + 1) for k, run in since.items()]
        ends: dict[int, int] = {}
        out = []
        for k, run, end in sorted(found, key=lambda x: (x[0], x[2])):
            if end - run >= self.rules[k].least:
                out.append((self._start(data, k, run, ends.get(k, 0)), k, end))
            ends[k] = end  # a match that is too short has taken its bytes all the same
        return sorted(out)

    def _start(self, data: bytes, k: int, run: int, floor: int) -> int:
        """The leftmost start of rule k's prefix that ends where the run begins, found by the prefix read backwards."""
        if not self.rules[k].prefix:
            return run
        p = backwards(self.rules[k])
        now, at, best = {q for q in range(len(p.classes)) if p.run in p.follow[q] and q != p.run}, run, run
        while now and at > floor:
            at -= 1
            now = {q for q in now if data[at] in p.classes[q]}
            if now & p.first:
                best = at
            now = {q for q in range(len(p.classes)) if q != p.run and p.follow[q] & now}
        return best


_BACK: dict[Rule, Positions] = {}


def backwards(rule: Rule) -> Positions:
    if rule not in _BACK:
        _BACK[rule] = Positions(rule)
    return _BACK[rule]


@cache
def compiled(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton.of(rules)


def scanner(rules: tuple[Rule, ...], carry: list[str]):
    automaton = compiled(rules)  # on the driver, once; it travels as arrays

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed = [[] for _ in rules], [], []
            for data in utf8(batch.column("text")):
                found = automaton.scan(data)
                # Offsets in code points: bytes that do not continue a character.
                points, done, past = [], 0, 0
                for cut in sorted({x for s, _, e in found for x in (s, e)}):
                    past += len(data[done:cut].decode("utf-8", "replace"))
                    done = cut
                    points.append((cut, past))
                point = dict(points)
                spans = [(point[s], k, point[e]) for s, k, e in found]
                text = [f"{rules[k].kind}:{s}:{e}" for s, k, e in spans]
                for i in range(len(rules)):
                    counts[i].append(sum(k == i for _, k, _ in spans))
                digests.append(hashlib.sha256(",".join(t for t, (_, k, _) in zip(text, spans, strict=True) if rules[k].base).encode()).hexdigest())
                listed.append(",".join(text))
            made = [pa.array(counts[i], pa.int64()) for i, r in enumerate(rules) if r.base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [*made, pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                names=[*carry, *(f"n_{r.kind}" for r in rules if r.base), "base_sha256", "spans"],
            )

    return scan


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All matches of all rules in every text: the columns of ``carry``, a count for each base rule, base_sha256, spans.

    spans lists kind:start:end in code points, by start, then by the order of the rules; base_sha256 is of
    the base rules' part of it. A null text is empty; an empty text has no spans and the hash of nothing.
    Rows are judged alone, so repeated rows give repeated results and an empty table an empty one.
    """
    own = docs.select(*(F.col(c) for c in carry), F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in carry)
    made = "".join(f", n_{r.kind} long" for r in rules if r.base)
    return own.mapInArrow(scanner(rules, list(carry)), f"{kinds}{made}, base_sha256 string, spans string")
