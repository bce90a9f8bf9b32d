"""Literals that every match of a pattern holds, so that a file without them needs no look at its lines."""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings of one set at most; shorter literals are in nearly every file and say nothing.
MOST, LEAST = 64, 2


def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Lower-cased strings of which every match, lower-cased, holds one at least; null if the pattern promises nothing useful."""
    try:
        _, found = _sequence(parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None  # a pattern in syntax of the executors' engine only
    least = {x for x in found or () if not any(y != x and y in x for y in found)}  # a string that holds another says nothing more
    return tuple(sorted(least)) if least and min(map(len, least)) >= LEAST else None


def holds_literal(text: Column, *patterns: str) -> Column:
    """True for each text that one of the patterns may match: it holds one of their literals, whatever the case. Much cheaper than the patterns; the text is lowered once."""
    held = [required_literals(p) for p in patterns]
    if not all(held):
        return F.lit(True)
    least = sorted({x for some in held for x in some})
    return F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in least]))


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest string is longer; of two such the smaller one."""
    worth = lambda s: (min(map(len, s)), -len(s))
    return max((s for s in (a, b) if s), key=worth, default=None)


def _sequence(items) -> tuple[set[str] | None, set[str] | None]:
    """All strings that the items match, if few; and a set of which each match holds one."""
    whole, run, best = True, {""}, None
    for item in items:
        exact, needed = _one(*item)
        if exact is not None and len(exact) * len(run) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        best, run, whole = _better(_better(best, run), _better(needed, exact)), {""}, False
    return (run if whole else None), _better(best, run)


def _one(kind, arg) -> tuple[set[str] | None, set[str] | None]:
    if kind is op.LITERAL:
        return {chr(arg).lower()}, None
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}, None
    if kind is op.IN and all(k is op.LITERAL for k, _ in arg):
        return {chr(x).lower() for _, x in arg}, None
    if kind is op.SUBPATTERN:
        return _sequence(arg[-1])
    if kind is op.ATOMIC_GROUP:
        return _sequence(arg)
    if kind is op.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        exact = set().union(*(e for e, _ in each)) if all(e is not None for e, _ in each) else None
        needed = [_better(e, n) for e, n in each]
        return (exact if exact is not None and len(exact) <= MOST else None), (set().union(*needed) if all(needed) else None)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, x = arg
        exact, needed = _sequence(x)
        if high == 1 and exact is not None:
            return (exact | {""} if low == 0 else exact), None
        return None, (_better(exact, needed) if low else None)
    return None, None
