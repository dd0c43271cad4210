"""Why a fact holds: a derivation tree, found on demand.

For a ground atom a rule whose head agrees is tried with the head's values put in; the filters reach the scans, so one
binding is fetched for each premise level and no lineage is kept while programs run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F

from hornspark.engine import Program
from hornspark.lang.parser import parse_atom
from hornspark.lang.syntax import Atom, Call, Clause, Compare, Const, LanguageError, Not, Var, variables
from hornspark.operators.relation import Relation
from hornspark.operators.rules import Body
from hornspark.values import constant, micros_time, python_value, term


@dataclass
class Derivation:
    """rule: None for a stated fact or one of an outside table, or where the tree was cut."""

    relation: str
    row: tuple
    rule: str | None = None
    premises: list[Derivation] = field(default_factory=list)
    absent: list[str] = field(default_factory=list)
    cut: str | None = None  # depth

    def json(self) -> dict:
        return {"relation": self.relation, "args": [str(term(v)) for v in self.row], "rule": self.rule, "premises": [p.json() for p in self.premises], "absent": self.absent, "cut": self.cut}


def derive(program: Program, atom: str | Atom, depth: int = 20) -> Derivation | None:
    """A derivation of a ground atom, None if it does not hold."""
    a = parse_atom(atom) if isinstance(atom, str) else atom
    if variables(a):
        raise LanguageError(f"{a} is not ground")
    return _derive(program, a.name, tuple(map(constant, a.terms)), depth, ())


def _holds(program: Program, name: str, row: tuple) -> bool:
    r = program.query(Atom(name, tuple(map(term, row))))
    return bool(r.local) if r.local is not None else not r.df.isEmpty()


def _derive(program: Program, name: str, row: tuple, depth: int, above: tuple) -> Derivation | None:
    if (name, repr(row)) in above:
        return None  # a derivation does not need itself
    if not _holds(program, name, row):
        return None
    if depth <= 0:
        return Derivation(name, row, cut="depth")
    path = (*above, (name, repr(row)))
    rules = [c for c in program.unit.clauses if c.head.name == name]
    for c in rules:
        if not c.body and program._constant(c) and tuple(map(constant, c.head.terms)) == row:
            return Derivation(name, row)
    for c in rules:
        if c.body:
            for env in _bindings(program, c, row):
                found = _with(program, c, env, row, depth, path)
                if found is not None:
                    return found
    if name not in program.heads:
        return Derivation(name, row)
    if name in program.temporal:
        return Derivation(name, row, rule="(coalesced)")
    return None  # only by a fact above it, so whoever asked tries another binding


def _bindings(program: Program, c: Clause, row: tuple) -> Iterator[dict]:
    """All bindings of the body's variables for which the rule gives the row, part by part."""
    if c.grouped:
        keys = [a.name for a in c.steps[0].call.args]
        c = replace(c, steps=())
        known = {t.name: v for t, v in zip(c.head.terms, row, strict=True) if isinstance(t, Var) and t.name in keys}
        tests = [Compare("=", Var(n), term(v)) for n, v in known.items()]
    else:
        tests = [Compare("=", t, term(v)) for t, v in zip(c.head.terms, row, strict=True) if not isinstance(t, Const) or constant(t) != v]
        if any(isinstance(t, Const) and constant(t) != v for t, v in zip(c.head.terms, row, strict=True)):
            return
    names = {v for p in c.body for v in variables(p)}
    # lets are folded into the head's tests
    lets = tuple(Compare("=", Var(s.var), s.call) for s in c.steps)
    whole = replace(c, body=(*c.body, *lets, *tests), steps=(), head=Atom(c.head.name, tuple(Var(n) for n in sorted(names))))
    look = program._lookup(c)

    def lookup(name: str, place: int) -> Relation:
        program.relation(name)
        return look(name, place)

    body = Body(program.spark, whole, lookup)
    body.build()
    own = sorted(n for n in names if n in body.slots)
    slots = [body.slots[n] for n in own]
    cols = [(F.unix_micros(s.column) if s.kind.name == "time" else F.col(s.column)).alias(f"c{i}") for i, s in enumerate(slots)]
    for r in body.frame().select(*cols).toLocalIterator():
        yield {n: micros_time(v) if s.kind.name == "time" else python_value(v, s.kind) for n, s, v in zip(own, slots, r, strict=True)}


def _with(program: Program, c: Clause, env: dict, row: tuple, depth: int, path: tuple) -> Derivation | None:
    out = Derivation(c.head.name, row, str(c))
    for p in c.body:
        if isinstance(p, Atom) and not p.name.startswith(":"):
            if not all(v in env for v in variables(p)) or any(isinstance(t, Call) for t in p.terms):
                continue
            own = tuple(env[t.name] if isinstance(t, Var) else constant(t) for t in p.terms)
            below = _derive(program, p.name, own, depth - 1, path)
            if below is None:
                return None
            out.premises.append(below)
        elif isinstance(p, Not):
            out.absent.append(str(p.atom))
    return out


__all__ = ["Derivation", "derive"]
