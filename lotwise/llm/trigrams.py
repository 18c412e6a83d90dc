"""Boolean trigram queries that every match of a regular expression must satisfy.

A query is ``None`` (nothing is mandatory), a trigram (str), or ``("and", q, ...)`` / ``("or", q, ...)``. The expression
is read into literal strings as far as they are few; where they end, what is known so far becomes a condition. Letters
are folded to lower case, since the index folds too.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

Query = None | str | tuple

# Literal strings followed at once, and characters of a class followed one by one.
MAX_STRINGS = 64
MAX_CLASS = 8


def both(kind: str, parts: list[Query]) -> Query:
    """Conjunction or disjunction with nested ones merged; ``None`` is neutral in "and" and absorbs "or"."""
    if kind == "or" and any(p is None for p in parts):
        return None
    flat: list[Query] = []
    for p in parts:
        for q in p[1:] if isinstance(p, tuple) and p[0] == kind else [p]:
            if q is not None and q not in flat:
                flat.append(q)
    if kind == "or":  # a demanding alternative adds nothing beside one that asks for part of it
        leaves = [_leaves(q) for q in flat]
        flat = [q for q, own in zip(flat, leaves) if own is None or not any(o is not None and o < own for o in leaves)]
    return None if not flat else flat[0] if len(flat) == 1 else (kind, *flat)


def _leaves(query: Query) -> set[str] | None:
    """The trigrams of a single one or a plain conjunction of them."""
    if isinstance(query, str):
        return {query}
    return set(query[1:]) if query[0] == "and" and all(isinstance(q, str) for q in query[1:]) else None


def _of_strings(strings: frozenset[str]) -> Query:
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items) -> frozenset[str] | None:
    """The characters of a class, folded, if they are few."""
    chars: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            chars.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 64:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(chars) if len(chars) <= MAX_CLASS else None


def _read(items) -> tuple[frozenset[str] | None, Query]:
    """(the strings the part can match, if few, and what each match must hold besides)."""
    known: frozenset[str] = frozenset([""])
    exact, conditions = True, []

    def cut() -> None:
        nonlocal known, exact
        conditions.append(_of_strings(known))
        known, exact = frozenset([""]), False

    for op, arg in items:
        strings, query, last = None, None, False
        if op is C.LITERAL:
            strings = frozenset([chr(arg).lower()])
        elif op is C.IN:
            strings = _class(arg)
        elif op is C.SUBPATTERN:
            strings, query = _read(arg[3])
        elif op is C.BRANCH:
            read = [_read(x) for x in arg[1]]
            if all(s is not None and q is None for s, q in read):
                strings = frozenset().union(*[s for s, _ in read])
            else:
                query = both("or", [both("and", [q, _of_strings(s) if s is not None else None]) for s, q in read])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner, inner_query = _read(body)
            if low == 0 and high == 1 and inner is not None and inner_query is None:
                strings = inner | {""}
            elif low >= 1:
                strings, query, last = inner, inner_query, not (low == high == 1)
        elif op is C.AT:
            continue
        if query is not None:
            conditions.append(query)
        if strings is None:
            cut()
            continue
        if len(known) * len(strings) > MAX_STRINGS:
            cut()
        known = frozenset(a + b for a in known for b in strings)
        if len(known) > MAX_STRINGS:
            cut()
        if last:
            cut()
    if exact:
        return known, both("and", conditions)
    conditions.append(_of_strings(known))
    return None, both("and", conditions)


def query_of(pattern: str) -> Query:
    strings, query = _read(_parser.parse(pattern))
    return both("and", [query, _of_strings(strings) if strings is not None else None])


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams_of(q) for q in query[1:]])
