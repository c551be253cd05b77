"""Secret scans with one combined deterministic automaton.

The rules' regexes, read by the pattern parser of Python's ``re``, become one NFA over bytes.  Subset construction makes
it deterministic, partition refinement minimises it, and the result is a flat transition array.  One pass over a text's
bytes runs all rules at once; where an accepting state says that a match of some rule ends, the rule's automaton of the
reversed regex reads back to its leftmost start, and its own automaton on to its longest end.

Rules are regexes of ASCII sets, alternatives and repeats, whose longest match is the greedy one.  The automata are
compiled once on the driver and sent with the task; their size depends on the rules.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from plansift.llm.common import col


class Rule(NamedTuple):
    """Matches of ``head + body`` are read leftmost and not overlapping; those whose body has fewer than ``least``
    characters are then dropped (with an empty head the body is the whole match).

    Counted repeats multiply the automaton's states: only where nothing else marks the rule does the regex count itself.
    """

    kind: str
    head: str
    body: str
    least: int


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
PRIVATE = r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----)?"

#: The first three are the base kinds, in the order in which equal starts are listed; the others are well-known token forms.
RULES = (
    Rule("assign", rf"""({KEYS})["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", "", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", "", r"[0-9a-f]{16,}", 16),
    Rule("private_key", "", PRIVATE, 1),
    Rule("github", "", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "", r"xox[abprs]-[A-Za-z0-9_-]+", 15),
    Rule("google", "", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
BASE = 3
EMPTY = -1  # the label of moves that read nothing


class Automaton(NamedTuple):
    """``step[state + byte]`` is the next state, each a multiple of 256; states from ``first_hit`` on are accepting."""

    step: list[int]
    first_hit: int
    hits: dict[int, int]  # accepting state -> bit mask of rules
    dead: int  # the state that nothing leaves, -1 without one


class Nfa:
    """Moves (from, bytes or EMPTY, to); ``place`` numbers the states of a run of equal byte sets.

    Whoever is further along such a run reaches its end first and leaves it no later, so of several places in one run
    only the furthest need be kept.
    """

    def __init__(self) -> None:
        self.size, self.moves, self.place = 0, [], {}

    def state(self) -> int:
        self.size += 1
        return self.size - 1

    def move(self, a: int, label: frozenset[int] | int, b: int) -> int:
        self.moves.append((a, label, b))
        return b

    def add(self, items, at: int) -> int:
        """The states of a parsed regex from ``at`` on; returns its last."""
        for op, value in items:
            if op is sre.SUBPATTERN:
                at = self.add(value[3], at)
            elif op is sre.BRANCH:
                ends = [self.add(branch, at) for branch in value[1]]
                at = self.state()
                for end in ends:
                    self.move(end, EMPTY, at)
            elif op is sre.MAX_REPEAT:
                at = self._repeat(*value, at)
            else:
                at = self.move(at, _byte_set(op, value), self.state())
        return at

    def _repeat(self, least: int, most: int, items, at: int) -> int:
        single = len(items) == 1 and items[0][0] in (sre.IN, sre.LITERAL)
        run = self.size
        for k in range(least):
            at = self.add(items, at)
            if single:
                self.place[at] = (run, k)
        if most is sre.MAXREPEAT:
            loop = self.move(at, EMPTY, self.state())
            self.move(self.add(items, loop), EMPTY, loop)
            if single:
                self.place[loop] = (run, least)
            return loop
        end = self.state()
        self.move(at, EMPTY, end)
        for _ in range(most - least):
            at = self.add(items, at)
            self.move(at, EMPTY, end)
        return end


def _byte_set(op, value) -> frozenset[int]:
    if op is sre.LITERAL:
        return frozenset([value])
    out: set[int] = set()
    for kind, v in value if op is sre.IN else ():
        out.update([v] if kind is sre.LITERAL else range(v[0], v[1] + 1))
    if not out or max(out) > 127:
        raise ValueError(f"rules are made of ASCII sets, alternatives and repeats, not {op} {value}")
    return frozenset(out)


def _shortest(items) -> list:
    """A parsed regex without what its shortest matches don't need at their end."""
    items = list(items)
    while items and items[-1][0] is sre.MAX_REPEAT:
        least, _, part = items.pop()[1]
        if least:
            return [*items, (sre.MAX_REPEAT, (least, least, part))]
    return items


def compile_rules(patterns: list[str], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """Subset construction over byte classes, then minimisation, then one flat transition list.

    ``anywhere``: matches start at any byte, and only where they first end matters; else they start at the first byte.
    ``backwards``: for bytes read from a match's end.
    """
    nfa = Nfa()
    start, accept = nfa.state(), {}
    for n, pattern in enumerate(patterns):
        first, items = nfa.state(), sre_parser.parse(pattern)
        last = nfa.add(_shortest(items) if anywhere else items, first)
        if backwards:
            first, last = last, first
        nfa.move(start, EMPTY, first) if not backwards else nfa.moves.append((first, EMPTY, start))
        accept[last] = n
    moves: list[dict[int, set[int]]] = [{} for _ in range(nfa.size)]
    empty: list[set[int]] = [set() for _ in range(nfa.size)]
    for a, label, b in nfa.moves:
        a, b = (b, a) if backwards else (a, b)
        if label == EMPTY:
            empty[a].add(b)
        else:
            for byte in label:
                moves[a].setdefault(byte, set()).add(b)
    if anywhere:
        for byte in range(256):
            moves[start].setdefault(byte, set()).add(start)
    return _determined(moves, empty, accept, {} if backwards or not anywhere else nfa.place, start)


def _determined(moves: list[dict[int, set[int]]], empty: list[set[int]], accept: dict[int, int], place: dict[int, tuple[int, int]], begin: int) -> Automaton:
    def closed(states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    def furthest(states: frozenset[int]) -> frozenset[int]:
        most: dict[int, int] = {}
        for s in states:
            if s in place:
                run, k = place[s]
                most[run] = max(most.get(run, 0), k)
        return frozenset(s for s in states if s not in place or place[s][1] == most[place[s][0]])

    closures = [closed({i}) for i in range(len(moves))]
    by_moves: dict[tuple, int] = {}  # bytes that every state treats alike form one class
    classes = [by_moves.setdefault(tuple(frozenset(m.get(b, ())) for m in moves), len(by_moves)) for b in range(256)]
    sample = [classes.index(k) for k in range(len(by_moves))]
    start = closures[begin]
    ids, order, table = {start: 0}, [start], []
    for states in order:  # grows as it goes
        row = []
        for b in sample:
            nxt = furthest(frozenset().union(*(closures[t] for s in states for t in moves[s].get(b, ()))))
            if nxt not in ids:
                ids[nxt] = len(order)
                order.append(nxt)
            row.append(ids[nxt])
        table.append(row)
    masks = [sum({1 << accept[s] for s in states if s in accept}) for states in order]
    block = masks
    while True:  # states stay together while they accept alike and their moves lead to the same blocks
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((block[i], *(block[t] for t in row)), len(seen)) for i, row in enumerate(table)]
        if len(seen) == len(set(block)):
            break
        block = new
    found: dict[int, int] = {}
    for i, k in enumerate(new):
        found.setdefault(k, i)
    ranked = sorted(found, key=lambda k: (masks[found[k]] != 0, found[k]))  # accepting states last
    number = {k: n * 256 for n, k in enumerate(ranked)}
    # the start is the first state unless it accepts, which no rule's does: a match has characters
    step = [number[new[table[found[k]][classes[b]]]] for k in ranked for b in range(256)]
    hits = {number[k]: masks[found[k]] for k in ranked if masks[found[k]]}
    dead = next((number[k] for k in ranked if not masks[found[k]] and all(new[t] == k for t in table[found[k]])), -1)
    return Automaton(step, min(hits, default=len(step)), hits, dead)


class Scanner(NamedTuple):
    """The automata of a set of rules: all at once, and of each rule forwards from a start, anywhere, and backwards."""

    rules: tuple[Rule, ...]
    all: Automaton
    ahead: list[Automaton]
    anywhere: list[Automaton]
    back: list[Automaton]
    head: list[Automaton | None]


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    whole = [r.head + r.body for r in rules]
    return Scanner(
        rules,
        compile_rules(whole),
        [compile_rules([p], anywhere=False) for p in whole],
        [compile_rules([p]) for p in whole],
        [compile_rules([p], anywhere=False, backwards=True) for p in whole],
        [compile_rules([r.head], anywhere=False) if r.head else None for r in rules],
    )


def _longest(auto: Automaton, data: bytes, at: int, stop: int, step: int = 1) -> int:
    """Where the longest match that begins at ``at`` ends (-1: none), reading towards ``stop``."""
    table, first_hit, dead = auto.step, auto.first_hit, auto.dead
    state, end = 0, -1
    while at != stop:
        state = table[state + data[at if step > 0 else at - 1]]
        at += step
        if state >= first_hit:
            end = at
        elif state == dead:
            break
    return end


def _first_end(auto: Automaton, data: bytes, at: int) -> int:
    """The end of the match that ends first from ``at`` on; -1 without any."""
    table, first_hit = auto.step, auto.first_hit
    state = 0
    for k in range(at, len(data)):
        state = table[state + data[k]]
        if state >= first_hit:
            return k + 1
    return -1


def scan(data: bytes, auto: Scanner) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes of what the rules find, sorted by start, then rule: one pass over the bytes for all
    rules, and for each match one back and one on.

    A match of a rule may begin before the end of the rule's last one, which it then must not: in that case the rule's
    own automaton goes on from that end to its next match.
    """
    table, first_hit, hits, _ = auto.all
    size, state = len(data), 0
    resume = [0] * len(auto.rules)
    out = []
    left = iter(data)
    for byte in left:
        state = table[state + byte]
        if state >= first_hit:
            end = size - operator.length_hint(left)
            mask = hits[state]
            while mask:
                n = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if end > resume[n]:
                    start = _longest(auto.back[n], data, end, resume[n], -1)
                    if start < 0:
                        later = _first_end(auto.anywhere[n], data, resume[n])
                        if later < 0:
                            resume[n] = size
                            continue
                        start = _longest(auto.back[n], data, later, resume[n], -1)
                    stop = resume[n] = _longest(auto.ahead[n], data, start, size)
                    body = start if auto.head[n] is None else _longest(auto.head[n], data, start, stop)
                    if stop - body >= auto.rules[n].least:
                        out.append((start, n, stop))
    return sorted(out)


def spans(text: str, auto: Scanner) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points."""
    data = text.encode()
    found = scan(data, auto)
    if not found or len(data) == len(text):
        return found
    at = {0: 0}
    last = 0
    for k in sorted({x for a, _, b in found for x in (a, b)}):
        at[k] = at[last] + len(data[last:k].decode())
        last = k
    return [(at[a], n, at[b]) for a, n, b in found]


def _listed(found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[n].kind}:{a}:{b}" for a, n, b in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each document: the id, counts of the base kinds, digest of the base spans, and all spans.

    One row per input row, repeated rows and null ids included.  A null or empty text has no spans: counts of 0, the
    digest of the empty string, and an empty list.  Very long texts take time in proportion to their length.  Other
    columns are not read; whole texts are; an empty table gives an empty one.
    """
    auto = scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], []]
            digests, lists = [], []
            for text in b.column("text").to_pylist():
                found = spans(text, auto) if text else []
                base = [x for x in found if x[1] < BASE]
                for k in range(BASE):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(_listed(base, auto.rules).encode()).hexdigest())
                lists.append(_listed(found, auto.rules))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string())],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
