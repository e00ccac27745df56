"""Terms evaluated in plain Python on one event: the oracle for both Spark strategies."""

from __future__ import annotations

import json
from urllib.parse import quote

MISSING = object()


def scalar(event, path):
    v = event
    for s in path:
        if isinstance(v, dict) and s in v:
            v = v[s]
        elif isinstance(v, list) and s.isdigit() and str(int(s)) == s and int(s) < len(v):
            v = v[int(s)]
        else:
            return MISSING
    return v


def kind(v):
    if v is MISSING or isinstance(v, (dict, list)):
        return None
    return "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"


def same(a, b):
    return kind(a) is not None and kind(a) == kind(b) and (float(a) == float(b) if kind(a) == "number" else a == b)


def at_least(a, b):
    if kind(a) != kind(b):
        return False
    return True if a is None else a.encode() >= b.encode() if isinstance(a, str) else a >= b


def term(event, path, op, value):
    v = scalar(event, path)
    if op == "=":
        return same(v, value)
    if op == "!":
        return not same(v, value)
    if op == "[":
        return isinstance(v, list) and any(same(x, value) for x in v)
    if op == "~":
        return kind(v) == "string" and v.encode().startswith(value.encode())
    up = at_least(v, value) if kind(v) else False
    down = at_least(value, v) if kind(v) else False
    return {"<": down and not same(v, value), "<=": down, ">": up and not same(v, value), ">=": up}[op]


def conjunction(event, terms):
    """Two bounds on one path are swapped if they are reversed; what is excluded stays excluded."""
    bounds = [(p, o, v) for p, o, v in terms if o[0] in "<>"]
    rest = [t for t in terms if t[1][0] not in "<>"]
    if len(bounds) == 2:
        (p, o1, a), (_, o2, b) = bounds
        low, high = (a, b) if at_least(b, a) else (b, a)
        open_ = [v for o, v in ((o1, a), (o2, b)) if len(o) == 1]
        if not (term(event, p, ">=", low) and term(event, p, "<=", high) and all(term(event, p, "!", v) for v in open_)):
            return False
    elif bounds:
        rest += bounds
    return all(term(event, *t) for t in rest)


def query(event, disjuncts):
    return any(conjunction(event, d) for d in disjuncts)


def text(disjuncts):
    """The query string of terms (path, op, value)."""
    esc = lambda s: s.replace("~", "~0").replace("/", "~1")
    say = lambda p, o, v: quote("../" + "/".join(map(esc, p)), safe="") + "=" + quote(("" if o == "=" else o) + json.dumps(v, ensure_ascii=False), safe="")
    return ";".join("&".join(say(*t) for t in d) for d in disjuncts)
