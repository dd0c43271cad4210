"""Programs: compile sources, bind outside tables, and ask for relations."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from hornspark.kinds import BOT, Kind, adapted, equal, literal, of_spark, unify
from hornspark.lang.packages import combined
from hornspark.lang.parser import parse_atom, parse_unit
from hornspark.lang.syntax import Atom, Call, Clause, Compare, Const, LanguageError, Not, Term, Unit, Var
from hornspark.operators.relation import Relation, empty, minus, of_rows, union
from hornspark.operators.rules import evaluate
from hornspark.operators.temporal import coalesce
from hornspark.plans.bounds import Bounds
from hornspark.plans.classes import Fold, fold
from hornspark.plans.fixpoint import solve
from hornspark.plans.stratify import Stratum, reachable, strata
from hornspark.values import constant, key, kind_of, once, term


class Engine:
    """Makes programs for a Spark session, whose time zone it sets to UTC."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def program(self, *sources: str, tables: dict[str, DataFrame | Relation] | None = None, facts: dict[str, Iterable[tuple]] | None = None, check: bool = True, **options) -> Program:
        """One program of one or more units. tables: outside relations; facts: rows of Python values for undefined relations.
        check: compile every rule now, not when it is asked for."""
        p = Program(self, [parse_unit(s) for s in sources], **options)
        for name, t in (tables or {}).items():
            p.bind(name, t)
        for name, rows in (facts or {}).items():
            p.insert(name, *rows)
        if check:
            p.check()
        return p


def from_frame(df: DataFrame, *, not_null: bool = False, distinct: bool = False, key: tuple[int, ...] | None = None) -> Relation:
    """A relation over a DataFrame, its columns by place. not_null, distinct, key: what the caller knows of the data, which
    spares null-safe joins, the removal of repeated rows before grouping, and pairs of values that a key shows to be alike."""
    kinds = tuple(of_spark(f.dataType) for f in df.schema.fields)
    cols = [adapted(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    return Relation(df.select(*cols), kinds, (not not_null,) * len(kinds), distinct or key is not None, key=key)


class Program:
    def __init__(self, engine: Engine, units: list[Unit], *, max_rounds: int = 10_000, small: bool = True, check_bounds: bool = True):
        self.engine, self.spark = engine, engine.spark
        self.unit = combined(units)
        self.max_rounds, self.small, self.check_bounds = max_rounds, small, check_bounds
        self.outside: dict[str, Relation] = {}
        self.removed: dict[str, Relation] = {}
        self.strata = strata(self.unit.clauses)
        self.heads = {c.head.name for c in self.unit.clauses}
        self.temporal = {d.atom.name for d in self.unit.decls if d.temporal} | {c.head.name for c in self.unit.clauses if c.head.interval} | {p.name for c in self.unit.clauses for p in c.body if isinstance(p, Atom) and p.interval}
        self.bounds = Bounds(self.unit.decls)
        if check_bounds:
            self.bounds.check_rules(self.unit.clauses)
        self._arities()
        self._done: dict[str, Relation] = {}
        self._shapes: dict[str, tuple] = {}

    # shape

    def _arities(self) -> None:
        self.arity: dict[str, int] = {}
        for c in self.unit.clauses:
            n = len(c.head.terms)
            if self.arity.setdefault(c.head.name, n) != n:
                raise LanguageError(f"line {c.line}: {c.head.name} has {self.arity[c.head.name]} columns elsewhere, {n} here")
        for d in self.unit.decls:
            n = len(d.atom.args) + 2 * d.temporal
            if self.arity.get(d.atom.name, n) != n and self.arity[d.atom.name] != len(d.atom.args) + 2:
                raise LanguageError(f"{d.atom.name} is declared with {n} columns and defined with {self.arity[d.atom.name]}")

    @property
    def undefined(self) -> set[str]:
        """Relations that are read but have no clause."""
        read = {p.atom.name if isinstance(p, Not) else p.name for c in self.unit.clauses for p in c.body if isinstance(p, Atom | Not)}
        return {n for n in read if not n.startswith(":")} - self.heads

    def relations(self) -> list[str]:
        return sorted(self.heads | set(self.outside) | self.undefined)

    # outside relations

    def bind(self, name: str, table: DataFrame | Relation) -> None:
        if name in self.heads:
            raise LanguageError(f"{name} has clauses, so it cannot also be an outside table")
        r = table if isinstance(table, Relation) else from_frame(table)
        if self.check_bounds:
            self.bounds.check_kinds(name, r.kinds)
        self.outside[name] = r
        self._forget()

    def _forget(self) -> None:
        """What was made and inferred of relations may not hold any more."""
        self._done.clear()
        self._shapes.clear()

    def insert(self, name: str, *rows: tuple) -> None:
        """State more facts. Results are made anew when next asked for."""
        self._change(name, rows, add=True)

    def retract(self, name: str, *rows: tuple) -> None:
        self._change(name, rows, add=False)

    def _change(self, name: str, rows: tuple, add: bool) -> None:
        if not rows:
            return
        width = {len(r) for r in rows}
        if len(width) > 1 or self.arity.get(name, min(width)) != min(width):
            raise LanguageError(f"{name}: rows of different length")
        kinds = tuple(reduce(unify, (kind_of(r[i]) for r in rows), BOT) for i in range(min(width)))
        r = of_rows(self.spark, [tuple(x) for x in rows], kinds)
        if name in self.heads:
            facts = [c for c in self.unit.clauses if c.head.name == name and not c.body]
            if len(facts) != sum(c.head.name == name for c in self.unit.clauses):
                raise LanguageError(f"{name} is derived; only stated facts can be changed")
            out = set() if add else set(map(key, rows))
            gone = [c for c in facts if self._constant(c) and key(tuple(map(constant, c.head.terms))) in out]
            new = [Clause(Atom(name, tuple(map(term, x)))) for x in rows] if add else []
            self.unit = replace(self.unit, clauses=tuple(c for c in self.unit.clauses if c not in gone) + tuple(new))
        elif name in self.outside:
            now = self.outside[name]
            if now.local is not None and r.local is not None and now.kinds == r.kinds:
                gone = set() if add else set(map(key, r.local))
                own = [x for x in now.local if key(x) not in gone]
                self.outside[name] = of_rows(self.spark, once([*own, *r.local]) if add else own, r.kinds)
            else:
                self.outside[name] = union([now, r]) if add else minus(now, r)
        elif add:
            self.outside[name] = r
        self._forget()

    # checking

    def check(self) -> None:
        """Compile every rule: unsafe variables, unknown functions and kinds that do not fit are errors now."""
        for s in self.strata:
            for n in s.names & self.heads:
                self.kinds(n)

    def kinds(self, name: str) -> tuple[Kind, ...]:
        return self._typed(name)[0]

    def _typed(self, name: str):
        if name not in self._shapes:
            stratum = next((s for s in self.strata if name in s.names), Stratum(frozenset([name]), False))
            if name not in self.heads:
                r = self._outside(name, self._width(name))
                self._shapes[name] = (r.kinds, r.nullable)
            else:
                self._infer(stratum)
        return self._shapes[name]

    def _width(self, name: str) -> int:
        if name in self.outside:
            return self.outside[name].arity
        uses = [len((p.atom if isinstance(p, Not) else p).terms) for c in self.unit.clauses for p in c.body if isinstance(p, Atom | Not) and (p.atom if isinstance(p, Not) else p).name == name]
        decl = [len(d.atom.args) + 2 * d.temporal for d in self.unit.decls if d.atom.name == name]
        return next(iter(decl + uses), 0)

    def _infer(self, s: Stratum) -> None:
        from hornspark.plans.fixpoint import infer

        rules = [c for c in self.unit.clauses if c.head.name in s.names and (c.body or not self._constant(c))]
        known = {}
        for n in s.names:
            f = self._facts(n)
            if f is not None:
                known[n] = f.kinds

        def look(name, place):
            kinds, nulls = self._typed(name)
            r = empty(self.spark, kinds)
            return Relation(r.df, kinds, nulls, True)

        got = infer(self.spark, s.names, rules, known, look, self.arity)
        for n, shape in got.items():
            if self.check_bounds:
                self.bounds.check_kinds(n, shape[0])
            self._shapes[n] = shape

    # evaluation

    @staticmethod
    def _constant(c: Clause) -> bool:
        def plain(t: Term) -> bool:
            return isinstance(t, Const) or isinstance(t, Call) and t.name in ("fn:list", "fn:pair", "fn:struct", "fn:map") and all(map(plain, t.args))

        return all(map(plain, c.head.terms))

    def _facts(self, name: str) -> Relation | None:
        """What is stated of a relation by clauses without a body and with constants only."""
        rows = [tuple(map(constant, c.head.terms)) for c in self.unit.clauses if c.head.name == name and not c.body and self._constant(c)]
        if not rows:
            return None
        if self.check_bounds:
            for r in rows:
                self.bounds.check_fact(name, r)
        kinds = tuple(reduce(unify, (kind_of(r[i]) for r in rows), BOT) for i in range(len(rows[0])))
        return replace(of_rows(self.spark, once(rows), kinds), distinct=True)

    def _outside(self, name: str, width: int) -> Relation:
        if name in self.outside:
            return self.outside[name]
        return empty(self.spark, (BOT,) * width)

    def relation(self, name: str) -> Relation:
        """A relation as a set. Only what it needs is evaluated; all but recursive strata stay lazy."""
        if name in self.heads:
            wanted = reachable(self.unit.clauses, {name})
            for s in self.strata:
                if s.names & wanted and s.names & self.heads and not s.names <= set(self._done):
                    self._evaluate(s)
            return self._done[name]
        r = self._outside(name, self._width(name)).as_set()
        return coalesce(r) if name in self.temporal and r.arity >= 2 else r

    def _lookup(self, clause: Clause):
        def look(name: str, place: int) -> Relation:
            if name in self._done:
                return self._done[name]
            p = clause.body[place]
            r = self._outside(name, len((p.atom if isinstance(p, Not) else p).terms))
            return coalesce(r) if name in self.temporal and name in self.outside and r.arity >= 2 else r

        return look

    def _rule(self, name: str) -> tuple[Clause, Callable] | None:
        """The one rule that gives all of a relation that is not recursive, and what its premises read."""
        rules = [c for c in self.unit.clauses if c.head.name == name]
        if len(rules) != 1 or not rules[0].body or name in self.temporal or any(s.recursive for s in self.strata if name in s.names):
            return None
        return rules[0], self._lookup(rules[0])

    def _evaluate(self, s: Stratum) -> None:
        rules = [c for c in self.unit.clauses if c.head.name in s.names and (c.body or not self._constant(c))]
        facts = {n: f for n in s.names if (f := self._facts(n)) is not None}
        if s.recursive:
            some = {p.name if isinstance(p, Atom) else p.atom.name: self._lookup(c)(p.name if isinstance(p, Atom) else p.atom.name, i) for c in rules for i, p in enumerate(c.body) if isinstance(p, Atom | Not) and not (p.name if isinstance(p, Atom) else p.atom.name).startswith(":") and (p.name if isinstance(p, Atom) else p.atom.name) not in s.names}
            by = Fold(some, {}) if s.names & self.temporal else fold(self.spark, s.names, rules, facts, some, self._rule)
            got = solve(self.spark, s.names, rules, facts, lambda name, place: by.inputs[name], self.arity, self.max_rounds, self.small)
            got = {n: by.whole(n, r) for n, r in got.items()}
        else:
            (name,) = s.names
            parts = [evaluate(self.spark, c, self._lookup(c)) for c in rules] + list(facts.values())
            got = {name: union(parts).as_set()}
            if self.check_bounds:
                self.bounds.check_kinds(name, got[name].kinds)
        for n, r in got.items():
            self._done[n] = coalesce(r) if n in self.temporal and r.arity >= 2 else r

    def _demanded(self, a: Atom) -> Relation | None:
        """For a query with constants on a recursive relation: only the rows that the constants ask for, where they are at
        places that every recursive rule hands on unchanged, so that the base rules alone need the filter."""
        s = next((s for s in self.strata if a.name in s.names), None)
        if s is None or not s.recursive or len(s.names) > 1 or a.name in self._done or a.name in self.temporal:
            return None
        rules = [c for c in self.unit.clauses if c.head.name == a.name]
        inner = {c: [p for p in c.body if isinstance(p, Atom) and p.name == a.name] for c in rules}
        places = [i for i, t in enumerate(a.terms) if isinstance(t, Const)]
        places = [i for i in places if all(len(ps) == 1 and len(ps[0].terms) == len(a.terms) == len(c.head.terms) and isinstance(c.head.terms[i], Var) and ps[0].terms[i] == c.head.terms[i] for c, ps in inner.items() if ps)]
        if not places:
            return None
        for name in reachable(self.unit.clauses, {a.name}) - {a.name}:
            if name in self.heads:
                self.relation(name)
        only = Program(self.engine, [], max_rounds=self.max_rounds, small=self.small, check_bounds=self.check_bounds)
        only.outside = {n: r for n, r in self.outside.items()} | {n: r for n, r in self._done.items()}
        asked = [replace(c, body=(*c.body, *(Compare("=", c.head.terms[i], a.terms[i]) for i in places))) if not inner[c] and not (not c.body and self._constant(c)) else c for c in rules]
        asked = [c for c in asked if c.body or not self._constant(c) or all(key((constant(c.head.terms[i]),)) == key((constant(a.terms[i]),)) for i in places)]
        only.unit = Unit(tuple(asked), tuple(d for d in self.unit.decls if d.atom.name == a.name))
        only.strata, only.heads, only.arity = strata(only.unit.clauses), {a.name} & {c.head.name for c in asked}, self.arity
        return only.relation(a.name) if only.heads else None

    def violations(self) -> dict[str, Relation]:
        """For each declaration with an inclusion constraint, the rows for which some atom of it does not hold."""
        out = {}
        for d in self.unit.decls:
            if d.inclusion:
                row = Atom("_row", d.atom.args)
                bad = [Clause(row, (Atom(d.atom.name, d.atom.args), Not(a))) for a in d.inclusion]
                parts = []
                for c in bad:
                    for n in (d.atom.name, c.body[1].atom.name):
                        if n in self.heads:
                            self.relation(n)
                    parts.append(evaluate(self.spark, c, self._lookup(c)))
                out[d.atom.name] = union(parts).as_set()
        return out

    def query(self, atom: str | Atom) -> Relation:
        """The rows of a relation that agree with an atom's constants and repeated variables; a bare name gives all.

        The filter goes into the plan of the relation, so Catalyst takes it down through rules that are not recursive.
        """
        a = parse_atom(atom) if isinstance(atom, str) else atom
        r = self._demanded(a) or self.relation(a.name)
        if not a.terms:
            return r
        if len(a.terms) != r.arity:
            raise LanguageError(f"{a.name} has {r.arity} columns, the query {len(a.terms)}")
        if r.local is not None:
            seen: dict[str, int] = {}
            keep = [x for x in r.local if all(_agrees(t, x, i, seen, a.terms) for i, t in enumerate(a.terms))]
            return replace(r, local=keep)
        df, first = r.df, {}
        for i, t in enumerate(a.terms):
            if isinstance(t, Const):
                c, k = literal(t.kind, t.value)
                from hornspark.kinds import Typed

                same = equal(r.column(i), Typed(c, k))
                df = df.where(F.lit(False) if same is None else same)
            elif isinstance(t, Var) and not t.anonymous:
                if t.name in first:
                    same = equal(r.column(first[t.name]), r.column(i))
                    df = df.where(F.lit(False) if same is None else same)
                first.setdefault(t.name, i)
        return r.with_frame(df)


def _agrees(t: Term, row: tuple, i: int, seen: dict, terms: tuple) -> bool:
    if isinstance(t, Const):
        v = constant(t)
        return kind_of(row[i]) == kind_of(v) and row[i] == v
    if isinstance(t, Var) and not t.anonymous:
        j = next(k for k, u in enumerate(terms) if u == t)
        return kind_of(row[i]) == kind_of(row[j]) and row[i] == row[j]
    return True


def evaluate_text(spark: SparkSession, *sources: str) -> dict[str, set]:
    """All relations of a program as sets of Python rows; for small programs."""
    p = Engine(spark).program(*sources)
    return {n: p.relation(n).facts() for n in p.relations()}
