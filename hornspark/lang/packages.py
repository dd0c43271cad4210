"""Packages: what a unit defines gets the package's prefix; other dotted names must be of used packages."""

from __future__ import annotations

from dataclasses import replace

from hornspark.lang.syntax import Atom, Clause, LanguageError, Not, Unit


def qualified(unit: Unit) -> Unit:
    """The unit with full names. Units without a package stay as they are."""
    if not unit.package:
        return unit
    own = {d.atom.name for d in unit.decls} | {c.head.name for c in unit.clauses}

    def name(n: str) -> str:
        if n in own:
            return f"{unit.package}.{n}"
        prefix = n.rpartition(".")[0]
        if prefix and not n.startswith(":") and prefix != unit.package and prefix not in unit.uses:
            raise LanguageError(f"{n}: package {prefix} is not used by {unit.package}")
        return n

    atom = lambda a: replace(a, name=name(a.name))
    premise = lambda p: atom(p) if isinstance(p, Atom) else Not(atom(p.atom)) if isinstance(p, Not) else p
    clauses = tuple(replace(c, head=atom(c.head), body=tuple(map(premise, c.body))) for c in unit.clauses)
    decls = tuple(replace(d, atom=atom(d.atom), inclusion=tuple(map(atom, d.inclusion))) for d in unit.decls)
    return replace(unit, clauses=clauses, decls=decls)


def combined(units: list[Unit]) -> Unit:
    clauses: list[Clause] = []
    decls = []
    for u in map(qualified, units):
        clauses += u.clauses
        decls += u.decls
    return Unit(tuple(clauses), tuple(decls))
