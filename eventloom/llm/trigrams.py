"""Boolean trigram queries from regular expressions.

For each part of an expression it is worked out which strings it can be (if they are few), how it can begin and end (the
last two characters), and which trigrams any match must contain. Queries are disjunctive: a set of clauses, each a set
of trigrams of which a matching text contains all. The query that every text answers is one empty clause.

Characters are folded to lower case, as texts are when they are indexed; characters beyond ASCII stand for any. What is
not understood (look-arounds, references) counts as the empty string or as anything, which only widens a query.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])
#: Characters of a class that are told apart, strings of a part, clauses of a query; beyond that a part is anything.
CLASS, STRINGS, CLAUSES = 8, 64, 64


def grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _least(clauses) -> Query:
    """Without clauses that others imply."""
    kept: list[frozenset[str]] = []
    for c in sorted(set(clauses), key=lambda c: (len(c), sorted(c))):
        if not any(k <= c for k in kept):
            kept.append(c)
    return frozenset(kept)


def either(a: Query, b: Query) -> Query:
    out = _least(a | b)
    return out if len(out) <= CLAUSES else ALL


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > CLAUSES**2:
        return min(a, b, key=len)
    out = _least(x | y for x in a for y in b)
    return out if len(out) <= CLAUSES else min(a, b, key=len)


def one_of(strings) -> Query:
    out = _least(grams(s) for s in strings)
    return out if len(out) <= CLAUSES else ALL


@dataclass(frozen=True)
class Part:
    """``exact``: all strings that it can be, or None; else what it begins and ends with; ``needs``: its trigrams."""

    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    needs: Query

    @classmethod
    def of(cls, strings) -> Part:
        held = frozenset(strings)
        if len(held) > STRINGS:
            return cls(None, frozenset(s[:2] for s in held), frozenset(s[-2:] for s in held), one_of(held))
        return cls(held, frozenset(), frozenset(), ALL)

    def open(self) -> Part:
        """As a part whose strings aren't known."""
        if self.exact is None:
            return self
        return Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), one_of(self.exact))


EMPTY, ANYTHING = Part.of([""]), Part(None, frozenset([""]), frozenset([""]), ALL)


def _join(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        return Part.of(x + y for x in a.exact for y in b.exact)
    x, y = a.open(), b.open()
    # What ends one part and begins the next: the trigrams across the seam.
    left = a.exact if a.exact is not None else x.ends
    right = b.exact if b.exact is not None else y.begins
    seam = one_of(p[-2:] + q[:2] for p in left for q in right) if len(left) * len(right) <= STRINGS else ALL
    begins = frozenset((p + q)[:2] for p in a.exact for q in y.begins) if a.exact is not None else x.begins
    ends = frozenset((p + q)[-2:] for p in x.ends for q in b.exact) if b.exact is not None else y.ends
    return Part(None, begins, ends, both(both(x.needs, y.needs), seam))


def _choice(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= STRINGS:
        return Part.of(a.exact | b.exact)
    x, y = a.open(), b.open()
    return Part(None, x.begins | y.begins, x.ends | y.ends, either(x.needs, y.needs))


def _character(code: int) -> Part:
    return Part.of([chr(code).lower()]) if code < 128 else ANYTHING


def _class(items: list) -> Part:
    codes: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes.add(value)
        elif kind is op.RANGE and value[1] - value[0] < 128:
            codes |= set(range(value[0], value[1] + 1))
        else:
            return ANYTHING
    chars = {chr(c).lower() for c in codes}
    return Part.of(chars) if len(chars) <= CLASS and max(codes) < 128 else ANYTHING


def _sequence(items) -> Part:
    out = EMPTY
    for kind, value in items:
        out = _join(out, _part(kind, value))
    return out


def _part(kind, value) -> Part:
    if kind is op.LITERAL:
        return _character(value)
    if kind is op.IN:
        return _class(value)
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.ATOMIC_GROUP:
        return _sequence(value)
    if kind is op.BRANCH:
        first, *more = map(_sequence, value[1])
        for p in more:
            first = _choice(first, p)
        return first
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        one = _sequence(inner)
        if most == 1:
            return one if least else _choice(EMPTY, one)
        out = EMPTY
        for _ in range(min(least, 3)):
            out = _join(out, one)
        if least == most <= 3:
            return out
        # Further repeats: anything, then the last of them again.
        out = _join(out, ANYTHING)
        return _join(out, one) if least > 3 else out
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return EMPTY
    return ANYTHING


def query(pattern: str) -> Query:
    """The clauses of which every match of ``pattern`` has all trigrams of one; ALL if it needs none."""
    return _sequence(parser.parse(pattern)).open().needs


def finder(trigrams: list[str]) -> str:
    """A pattern for all places where one of the trigrams begins; group 1 is the trigram."""
    heads = itertools.groupby(sorted(trigrams), key=lambda t: t[0])
    quote = lambda c: c if c.isalnum() else "\\" + c
    branch = [quote(a) + "(?:" + "|".join(quote(t[1]) + quote(t[2]) for t in held) + ")" for a, held in heads]
    first = "".join(quote(a) for a in sorted({t[0] for t in trigrams}))
    return f"(?=[{first}])(?=({'|'.join(branch)}))"
