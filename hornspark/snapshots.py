"""What a program looks like from outside, as JSON: its relations and rules, and the facts of small relations."""

from __future__ import annotations

import json
from itertools import islice

from hornspark.engine import Program
from hornspark.kinds import Kind
from hornspark.lang.printer import duration_text, float_text, time_text
from hornspark.lang.syntax import Atom, Not
from hornspark.values import Entries, Name, kind_of, term


def json_value(v: object) -> object:
    """Numbers and strings as they are, names, times and durations as text, compounds as arrays or objects."""
    match kind_of(v).name:
        case "bot":
            return None
        case "number":
            return int(v)
        case "float64":
            return v if v == v and abs(v) != float("inf") else float_text(v)
        case "time":
            return time_text(term(v).value)
        case "duration":
            return duration_text(term(v).value)
        case "list" | "pair":
            return list(map(json_value, v))
        case "map":
            return [[json_value(k), json_value(x)] for k, x in Entries(v)]
        case "struct":
            return {k: json_value(x) for k, x in v.items()}
        case "bytes":
            return v.hex()
    return str(v)


def value_of(x: object) -> object:
    """A JSON value as one of a fact; {"@name": "/a"} is a name."""
    if isinstance(x, dict):
        return Name(x["@name"]) if set(x) == {"@name"} else {k: value_of(v) for k, v in x.items()}
    return [value_of(v) for v in x] if isinstance(x, list) else x


def schema(program: Program) -> str:
    """Relations with arity, kinds and what they depend on, and the rules."""

    def entry(name: str) -> dict:
        kinds: tuple[Kind, ...] = program.kinds(name)
        return {"name": name, "arity": len(kinds), "kinds": list(map(str, kinds)), "derived": name in program.heads, "temporal": name in program.temporal}

    rules = [
        {"head": c.head.name, "text": str(c), "premises": [p.atom.name if isinstance(p, Not) else p.name for p in c.body if isinstance(p, Atom | Not)], "negated": [p.atom.name for p in c.body if isinstance(p, Not)], "grouped": c.grouped}
        for c in program.unit.clauses
        if c.body
    ]
    return json.dumps({"relations": [entry(n) for n in program.relations()], "rules": rules})


def facts(program: Program, names: list[str] | None = None, most: int = 10_000) -> str:
    """Rows of relations, at most so many of each, which then says so."""
    out = {}
    for n in names or program.relations():
        rows = list(islice(program.relation(n).rows(), most + 1))
        out[n] = {"rows": [list(map(json_value, r)) for r in rows[:most]], "complete": len(rows) <= most}
    return json.dumps(out)
