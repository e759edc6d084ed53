"""Boolean trigram queries from regular expressions (after Cox, "Regular Expression Matching with a Trigram Index").

``query(pattern)`` gives a disjunction of conjunctions: a list of frozensets of lower-case trigrams, such that every
match of the pattern contains, case folded, all trigrams of one of the sets. None: no trigram is mandatory.
"""

from __future__ import annotations

import itertools
import re._constants as C
import re._parser as parser

#: Sets of exact strings larger than this are given up and turned into conjunctions of what they contain.
MOST = 48


class _Part:
    """exact: all strings it can match, or None; need: a disjunction of conjunctions of trigrams, or None (anything)."""

    def __init__(self, exact, need=None):
        self.exact, self.need = exact, need

    def demand(self):
        if self.exact is None:
            return self.need
        if any(len(s) < 3 for s in self.exact):
            return None
        return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(self.exact)]


def _both(a, b):
    if a is None or b is None:
        return a if b is None else b
    if len(a) * len(b) > MOST:
        return a if len(a) <= len(b) else b
    return list(dict.fromkeys(x | y for x, y in itertools.product(a, b)))


def _joined(parts):
    """Concatenation: neighbouring exact parts are multiplied out while they stay small."""
    runs, need = [], None
    for p in parts:
        if p.exact is not None and runs and runs[-1].exact is not None and len(runs[-1].exact) * len(p.exact) <= MOST:
            runs[-1] = _Part({x + y for x in runs[-1].exact for y in p.exact})
        else:
            runs.append(p)
    if len(runs) == 1:
        return runs[0]
    for p in runs:
        need = _both(need, p.demand())
    return _Part(None, need)


def _characters(items):
    out = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < MOST:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 6 else None


def _walk(node):
    parts = []
    for op, value in node:
        if op is C.LITERAL:
            parts.append(_Part({chr(value).lower()}))
        elif op is C.IN:
            parts.append(_Part(_characters(value)))
        elif op is C.SUBPATTERN:
            parts.append(_walk(value[3]))
        elif op is C.BRANCH:
            options = [_walk(x) for x in value[1]]
            if all(x.exact is not None for x in options) and sum(len(x.exact) for x in options) <= MOST:
                parts.append(_Part(set().union(*(x.exact for x in options))))
            else:
                demands = [x.demand() for x in options]
                parts.append(_Part(None, None if None in demands else [y for d in demands for y in d]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            body = _walk(inner)
            if low == 0 and high == 1 and body.exact is not None:
                parts.append(_Part(body.exact | {""}))
            elif low == 0:
                parts.append(_Part(None))
            elif body.exact is not None and len(body.exact) == 1 and low == high:
                parts.append(_Part({next(iter(body.exact)) * low}))
            else:
                parts += [_Part(body.exact, body.need)] + [_Part(None)]
        elif op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
            parts.append(_Part({""}))
        else:
            parts.append(_Part(None))
    return _joined(parts) if parts else _Part({""})


def query(pattern: str) -> list[frozenset[str]] | None:
    found = _walk(parser.parse(pattern)).demand()
    if found is None:
        return None
    return [x for x in found if not any(y < x for y in found)]
