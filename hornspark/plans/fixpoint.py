"""Semi-naive fixpoints of recursive strata.

In each round a rule is evaluated once for each of its premises in the stratum: that premise reads the rows that are new
since the last round, those before it all rows, those after it the rows known before. What a round finds is written to
the shared folder, so plans do not grow; after some rounds the parts of a relation are written as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession

from hornspark.kinds import BOT, Kind, unify
from hornspark.lang.syntax import Atom, Clause, LanguageError
from hornspark.operators.relation import Relation, empty, minus, union
from hornspark.operators.rules import Lookup, evaluate
from hornspark.plans import local
from hornspark.plans.storage import kept

#: Parts of a relation before they are written as one.
PARTS = 12


class Stored:
    """A relation that grows by written parts."""

    def __init__(self, spark: SparkSession, kinds: tuple[Kind, ...], nullable: tuple[bool, ...]):
        self.spark, self.kinds, self.nullable = spark, kinds, nullable
        self.paths: list[str] = []
        self.schema = None

    def relation(self, paths: list[str]) -> Relation:
        if not paths:
            return empty(self.spark, self.kinds)
        return Relation(self.spark.read.schema(self.schema).parquet(*paths), self.kinds, self.nullable, True)

    @property
    def all(self) -> Relation:
        return self.relation(self.paths)

    def add(self, r: Relation) -> tuple[Relation, int]:
        """Write rows that are not yet there; gives them, and how many they are."""
        df, path = kept(r.df)
        n = df.count()
        if n:
            self.schema = df.schema
            self.paths = [*self.paths, path]
        return Relation(df, self.kinds, self.nullable, True), n


def infer(spark: SparkSession, names: frozenset[str], clauses: list[Clause], known: dict[str, tuple[Kind, ...]], lookup: Lookup, arities: dict[str, int]) -> dict[str, tuple[tuple[Kind, ...], tuple[bool, ...]]]:
    """Kinds and nullability of the columns, by evaluating plans over empty relations until nothing changes."""
    kinds = {n: known.get(n, (BOT,) * arities[n]) for n in names}
    nulls = {n: (False,) * arities[n] for n in names}
    inner = lambda c: sum(isinstance(p, Atom) and p.name in names for p in c.body)
    clauses = sorted(clauses, key=inner)
    for _ in range(20):
        before = dict(kinds), dict(nulls)
        for c in clauses:
            def look(name, place, c=c):
                if name in names:
                    r = empty(spark, kinds[name])
                    return Relation(r.df, r.kinds, nulls[name], True)
                return lookup(name, place)

            r = evaluate(spark, c, look)
            n = c.head.name
            kinds[n] = tuple(map(unify, kinds[n], r.kinds))
            nulls[n] = tuple(a or b for a, b in zip(nulls[n], r.nullable, strict=True))
        if before == (kinds, nulls):
            return {n: (kinds[n], nulls[n]) for n in names}
    raise LanguageError("the kinds of " + ", ".join(sorted(names)) + " do not settle")


def solve(spark: SparkSession, names: frozenset[str], clauses: list[Clause], facts: dict[str, Relation], lookup: Lookup, arities: dict[str, int], max_rounds: int, small: bool = True) -> dict[str, Relation]:
    """All relations of one recursive stratum. facts: what is stated of them."""
    quick = _on_driver(spark, names, clauses, facts, lookup) if small and local.fits(clauses) else None
    if quick is not None:
        return quick
    base = [c for c in clauses if not any(isinstance(p, Atom) and p.name in names for p in c.body)]
    steps = [c for c in clauses if c not in base]
    shape = infer(spark, names, clauses, {n: r.kinds for n, r in facts.items()}, lookup, arities)
    stores, deltas, grew = {}, {}, False
    for n in names:
        stores[n] = Stored(spark, shape[n][0], tuple(a or b for a, b in zip(shape[n][1], facts[n].nullable, strict=True)) if n in facts else shape[n][1])
        parts = [evaluate(spark, c, lookup) for c in base if c.head.name == n] + ([facts[n]] if n in facts else [])
        if parts:
            deltas[n], k = stores[n].add(union(parts).converted(shape[n][0]).as_set())
            grew |= k > 0
        else:
            deltas[n] = empty(spark, shape[n][0])
    old = {n: [] for n in names}
    rounds = 0
    while grew:
        rounds += 1
        if rounds > max_rounds:
            raise LanguageError(f"no fixpoint of {', '.join(sorted(names))} after {max_rounds} rounds")
        found: dict[str, list[Relation]] = {n: [] for n in names}
        for c in steps:
            places = [i for i, p in enumerate(c.body) if isinstance(p, Atom) and p.name in names]
            for turn in places:
                def look(name, place, turn=turn):
                    if name not in names:
                        return lookup(name, place)
                    if place == turn:
                        return deltas[name]
                    return stores[name].all if place < turn else stores[name].relation(old[name])

                found[c.head.name].append(evaluate(spark, c, look))
        old = {n: list(stores[n].paths) for n in names}
        fresh, grew = {}, False
        for n, parts in found.items():
            if not parts:
                fresh[n] = empty(spark, shape[n][0])
                continue
            fresh[n], k = stores[n].add(minus(union(parts).converted(shape[n][0]).as_set(), stores[n].all))
            grew |= k > 0
        deltas = fresh
        for n, s in stores.items():
            if len(old[n]) > PARTS:
                last = s.paths[len(old[n]):]
                old[n] = [kept(s.relation(old[n]).df)[1]]
                s.paths = old[n] + last
    return {n: s.all for n, s in stores.items()}


def _on_driver(spark, names, clauses, facts, lookup) -> dict[str, Relation] | None:
    inputs, kinds = {}, {}
    for c in clauses:
        for i, p in enumerate(c.body):
            if isinstance(p, Atom) and p.name not in names and p.name not in inputs:
                r = lookup(p.name, i)
                if any(isinstance(q, Atom) and q.name == p.name and len(q.terms) != r.arity for d in clauses for q in d.body):
                    return None
                rows = local.rows_of(r)
                if rows is None:
                    return None
                inputs[p.name], kinds[p.name] = rows, r.kinds
    start = {}
    for n, r in facts.items():
        rows = local.rows_of(r)
        if rows is None:
            return None
        start[n] = rows
    # values of different kinds must not meet where Python would call them equal or compare them
    got = local.fixpoint(names, clauses, inputs, start) if _plain(names, clauses, kinds, facts) else None
    if got is None:
        return None
    from hornspark.values import kind_of

    out = {}
    for n, rows in got.items():
        width = len(next(c for c in clauses if c.head.name == n).head.terms)
        k = tuple(reduce(unify, (kind_of(r[i]) for r in rows), BOT) for i in range(width))
        out[n] = Relation(None, k, (False,) * width, True, local=sorted(rows, key=repr), spark=spark)
    return out


def _plain(names, clauses, kinds, facts) -> bool:
    """Each variable of each clause has one kind, whichever premise binds it."""
    cols = dict(kinds) | {n: r.kinds for n, r in facts.items()}
    literal = {"number": "number", "string": "string", "name": "name"}
    for _ in range(len(names) + 1):
        for c in clauses:
            own: dict[str, str] = {}
            for p in c.body:
                for i, t in enumerate(p.terms if isinstance(p, Atom) else ()):
                    if p.name in cols:
                        if i >= len(cols[p.name]):
                            return False
                        k = cols[p.name][i].name
                        k0 = own.setdefault(t.name, k) if hasattr(t, "name") else literal[t.kind]
                        if k not in (k0, "bot") and k0 != "bot":
                            return False
            for p in c.body:
                if not isinstance(p, Atom):
                    sides = {own.get(t.name) if hasattr(t, "name") else literal[t.kind] for t in (p.left, p.right)}
                    if len(sides - {None}) > 1:
                        return False
            head = tuple(Kind(own.get(t.name, "bot") if hasattr(t, "name") else literal[t.kind]) for t in c.head.terms)
            if c.head.name in cols:
                if len(cols[c.head.name]) != len(head):
                    return False
                try:
                    both = tuple(map(unify, cols[c.head.name], head))
                except LanguageError:
                    return False
                if any(k.name == "any" for k in both):
                    return False
                cols[c.head.name] = both
            else:
                cols[c.head.name] = head
    return True
