"""Secrets in listing descriptions, found by one combined deterministic automaton.

The rules' regular expressions become one nondeterministic automaton over bytes, read backwards;
subset construction makes it deterministic, merging of equivalent states makes it small, and its
transitions lie in arrays.  One pass over a text's bytes from the end to the beginning marks, for all
rules at once, every place where a match begins.  From the leftmost such place the rule's own small
automaton runs forward to the longest end; the search goes on behind it.

A text is one row's work; nothing is shuffled, gathered or broadcast but the arrays, whose size the
rules fix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.wire import gives_back

SPANS = "array<struct<kind: string, start: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``pattern`` is a regular expression over ASCII of literals, ``[...]``, ``(...)``, ``|``, ``?``, ``*``, ``+``,
    ``{n}`` and ``{n,}``; ``(?i:...)`` takes letters in either case.  A match shorter than ``least`` characters is
    passed over as a whole; with ``tail`` only the characters from the first possible end on are counted, that is,
    those of a pattern's last repeated class.  ``more`` is what a match goes on over where it can; it may be empty, so
    that it takes no part in finding where matches begin.
    """

    kind: str
    pattern: str
    least: int = 1
    tail: bool = False
    more: str = ""


#: The three base kinds, in their listed order.
BASE_RULES = (
    Rule(
        "assign",
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
        least=8,
        tail=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: A private key runs to its END line, over whatever a source wraps its lines in (escapes, quotes, indents), but not
#: over two dashes, where another key may begin.  A key cut short has no such line: its header fields, then runs of at
#: least 16 base64 characters, and behind them one that may be shorter.
_PEM_WHOLE = r"(-?[\x00-,.-\xff])*-----END\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"
_PEM_GAP = r"([\x09\x0a\x0d\x20\"'>,+]|\\[nrt]?)*"
_PEM_CUT = (
    rf"({_PEM_GAP}(Proc-Type|DEK-Info):[A-Za-z0-9,\x20-]+)*"
    rf"({_PEM_GAP}[A-Za-z0-9+/=]{{16,}})*({_PEM_GAP}[A-Za-z0-9+/=]+)?"
)
#: Kinds added to the base ones.
MORE_RULES = (
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", more=f"{_PEM_WHOLE}|{_PEM_CUT}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", least=24),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]+", least=24, tail=True),
)
RULES = BASE_RULES + MORE_RULES


class _Parser:
    """Recursive descent over one pattern: ('set', bytes) | ('seq', [..]) | ('or', [..]) | ('star', x) | ('maybe', x)."""

    def __init__(self, pattern: str):
        self.text, self.at, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, expected: str = "") -> str:
        found = self.peek()
        if not found or (expected and found != expected):
            raise ValueError(f"bad pattern {self.text!r} at {self.at}")
        self.at += 1
        return found

    def whole(self):
        tree = self.choice()
        if self.peek():
            raise ValueError(f"bad pattern {self.text!r} at {self.at}")
        return tree

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        part = self.single()
        while self.peek() in ("?", "*", "+", "{"):
            sign = self.take()
            if sign == "?":
                part = ("maybe", part)
            elif sign == "*":
                part = ("star", part)
            elif sign == "+":
                part = ("seq", [part, ("star", part)])
            else:
                digits = ""
                while self.peek().isdigit():
                    digits += self.take()
                open_end = self.peek() == "," and bool(self.take())
                self.take("}")
                part = ("seq", [part] * int(digits) + [("star", part)] * open_end)
        return part

    def symbol(self) -> int:
        found = self.take()
        if found != "\\":
            return ord(found)
        found = self.take()
        if found == "x":
            return int(self.take() + self.take(), 16)
        if found.isalnum():
            raise ValueError(f"unknown escape in {self.text!r}")
        return ord(found)

    def single(self):
        if self.peek() == "(":
            self.take()
            before = self.fold
            if self.text.startswith("?i:", self.at):
                self.at += 3
                self.fold = True
            inner = self.choice()
            self.take(")")
            self.fold = before
            return inner
        if self.peek() == "[":
            self.take()
            members = set()
            while self.peek() != "]":
                low = high = self.symbol()
                if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                    self.take()
                    high = self.symbol()
                members.update(range(low, high + 1))
            self.take("]")
        else:
            members = {self.symbol()}
        if self.fold:
            members = {ord(y) for x in members for y in (chr(x).lower(), chr(x).upper())}
        return ("set", frozenset(members))


def _backwards(tree):
    kind, inner = tree
    if kind == "seq":
        return kind, [_backwards(x) for x in reversed(inner)]
    if kind == "or":
        return kind, [_backwards(x) for x in inner]
    return tree if kind == "set" else (kind, _backwards(inner))


class _Network:
    """States with free steps and steps on byte sets."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def build(self, tree, start: int) -> int:
        """Lays a tree out behind ``start`` and returns its end."""
        kind, inner = tree
        if kind == "set":
            end = self.state()
            middle = self.state()
            self.free[start].append(middle)
            self.step[middle] = (inner, end)
            return end
        if kind == "seq":
            for part in inner:
                start = self.build(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in inner:
                self.free[self.build(part, start)].append(end)
            return end
        entry, end = self.state(), self.state()
        self.free[start].append(entry)
        last = self.build(inner, entry)
        self.free[entry].append(end)
        self.free[last].append(entry if kind == "star" else end)
        return end

    def closure(self, states) -> frozenset:
        found, open_ = set(states), list(states)
        while open_:
            for x in self.free[open_.pop()]:
                if x not in found:
                    found.add(x)
                    open_.append(x)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``rows[state][class]`` is the next state; a state from ``quiet`` on accepts ``kinds[state]``; state 0 starts."""

    classes: bytes
    rows: list[list[int]]
    quiet: int
    kinds: list[tuple[int, ...]]
    dead: int


def compile_rules(rules: Sequence[Rule], anchored: bool, backward: bool) -> Automaton:
    """The minimal deterministic automaton of several rules; unanchored ones may begin at any byte."""
    net = _Network()
    root = net.state()
    ends = {}
    for number, rule in enumerate(rules):
        tree = _Parser(rule.pattern).whole()
        if rule.more and not backward:
            tree = ("seq", [tree, _Parser(rule.more).whole()])
        ends[net.build(_backwards(tree) if backward else tree, root)] = number
    if not anchored:
        net.step.append((frozenset(range(256)), root))
        net.free.append([])
        net.free[root].append(len(net.free) - 1)

    steps = [x for x in net.step if x]
    signatures: dict[tuple, int] = {}
    classes = bytes(signatures.setdefault(tuple(b in s for s, _ in steps), len(signatures)) for b in range(256))
    first_byte = [classes.index(c) for c in range(len(signatures))]

    numbers = {net.closure([root]): 0}
    subsets, table = list(numbers), []
    for subset in subsets:
        row = []
        for byte in first_byte:
            to = net.closure([net.step[s][1] for s in subset if net.step[s] and byte in net.step[s][0]])
            if to not in numbers:
                numbers[to] = len(subsets)
                subsets.append(to)
            row.append(numbers[to])
        table.append(row)
    table = np.array(table)
    accepts = [tuple(sorted({ends[s] for s in subset if s in ends})) for subset in subsets]

    # States are equivalent if they accept the same and their steps lead to equivalent states.
    labels: dict[tuple, int] = {}
    part = np.array([labels.setdefault(a, len(labels)) for a in accepts])
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    some = {int(p): s for s, p in reversed(list(enumerate(part)))}
    order = sorted(some, key=lambda p: (bool(accepts[some[p]]), some[p]))
    place = {p: n for n, p in enumerate(order)}
    rows = [[place[int(part[t])] for t in table[some[p]]] for p in order]
    kinds = [accepts[some[p]] for p in order]
    dead = next((n for n, row in enumerate(rows) if not kinds[n] and set(row) == {n}), -1)
    if place[int(part[0])] != 0:
        raise ValueError("a rule matches the empty text")
    return Automaton(classes, rows, sum(1 for k in kinds if not k), kinds, dead)


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton]]:
    return compile_rules(rules, False, True), [compile_rules([r], True, False) for r in rules]


def find_spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in characters, by start and then rule; leftmost longest and not overlapping in each kind."""
    backward, forward = _compiled(rules)
    data = text.encode()
    rows, quiet, state = backward.rows, backward.quiet, 0
    begins: list[tuple[int, int]] = []
    for at, symbol in enumerate(data.translate(backward.classes)[::-1], 1):
        state = rows[state][symbol]
        if state >= quiet:
            begins.append((len(data) - at, state))
    if not begins:
        return []
    found = []
    behind = [0] * len(rules)
    for start, state in reversed(begins):
        for number in backward.kinds[state]:
            if start < behind[number]:
                continue
            automaton, rule = forward[number], rules[number]
            steps, classes, dead, now = automaton.rows, automaton.classes, automaton.dead, 0
            first = end = 0
            for at in range(start, len(data)):
                now = steps[now][classes[data[at]]]
                if now >= automaton.quiet:
                    end = at + 1
                    first = first or end
                elif now == dead:
                    break
            behind[number] = end
            if (end - first + 1 if rule.tail else end - start) >= rule.least:
                found.append((start, number, end))
    wide = len(data) != len(text)
    place = (lambda byte: len(data[:byte].decode())) if wide else (lambda byte: byte)
    return [(rules[number].kind, place(start), place(end)) for start, number, end in sorted(found)]


def scan_secrets(listings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(id, spans): the secrets of every listing's ``description`` by start, then by rule.

    ``start`` and ``end`` (exclusive) count characters.  Within a kind, matches are leftmost, longest and do not
    overlap; kinds may overlap one another.  A null or empty description has no spans.  One row per input row,
    repeated rows and null ids included; other columns are not read; an empty table gives none.
    """
    rules = tuple(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text.as_py() or "", rules)]
                for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    texts = listings.select(F.col("id").cast("long").alias("id"), F.col("description").cast("string"))
    return texts.mapInArrow(run, f"id long, spans {SPANS}")


def spans_text(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the spans, joined by commas; only of some kinds if they are named."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_secrets(listings: DataFrame, mask: str = "[secret]", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The listings with every secret in ``description`` replaced; overlapping spans become one mask.

    Columns, rows and nulls stay as they are.  The other columns pass through the worker as they come; a batch at a time
    is held there.
    """
    rules = tuple(rules)
    place = listings.columns.index("description")

    def one(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, start, end in find_spans(text, rules):
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join(out) + text[at:] if out else text

    @gives_back
    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            yield batch.set_column(place, "description", pa.array([one(x.as_py()) for x in texts], texts.type))

    return listings.mapInArrow(masked, listings.schema)
