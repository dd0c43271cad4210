"""Recursion over classes of values that no rule can tell apart.

Where a value enters a recursive stratum only through one column of a relation e, and e's rule takes it from one atom,
the values for which that atom's other variables have the same bindings are interchangeable: exchanging two of them
leaves e, and so all that is derived from it, as it was. The fixpoint is then found over the least value of each class.
That is all of it: the least values of a derivation's values make a derivation too, and what holds of a tuple holds of
every tuple of the same classes. Columns with constants, comparisons, functions, negation or stated rows, those that
meet another column of e or of a second relation, and relations with two columns of one such sort are left as they are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession, functions as F

from hornspark.kinds import NAME, NUMBER, STRING, TIME
from hornspark.lang.syntax import Atom, Clause, Compare, Const, Not, Var, variables
from hornspark.operators.relation import Classes, Folded, Relation
from hornspark.operators.rules import Lookup, evaluate

#: A relation's column.
Place = tuple[str, int]
_VALUES, _LINKS = {NUMBER, STRING, NAME}, {NUMBER, STRING, NAME, TIME}


@dataclass(frozen=True)
class Fold:
    """What a stratum reads instead of its inputs, and the classes of its columns."""

    inputs: dict[str, Relation]
    classes: dict[Place, Classes]

    def whole(self, name: str, core: Relation) -> Relation:
        """All rows of a relation, from those of least values."""
        columns = tuple(self.classes.get((name, i)) for i in range(core.arity))
        if core.local == [] or not any(columns):
            return core
        folded = Folded(core, columns)
        return replace(core, frame=folded.expanded(core.df, range(core.arity)), local=None, folded=folded)


def fold(spark: SparkSession, names: frozenset[str], clauses: list[Clause], facts: Iterable[str], inputs: dict[str, Relation], rule: Callable[[str], tuple[Clause, Lookup] | None]) -> Fold:
    """rule: the one rule that defines an input, and what its premises read; None if there are more, or none."""
    found: dict[Place, Classes] = {}
    limits: dict[str, dict[int, list[tuple[int, Classes]]]] = defaultdict(lambda: defaultdict(list))
    for source, places in sorts(names, clauses, facts, {n: r.arity for n, r in inputs.items()}).items():
        got = rule(source[0])
        made = got and _classes(spark, *got, source[1])
        if made:
            at, column, classes = made
            limits[source[0]][at].append((column, classes))
            found |= dict.fromkeys(places, classes)
    least = dict(inputs)
    for n, by in limits.items():
        clause, lookup = rule(n)

        def look(name, place, by=by, lookup=lookup):
            r = lookup(name, place)
            for column, classes in by.get(place, ()):
                reps = classes.sizes.select("rep")
                r = r.with_frame(r.df.join(reps, F.col(f"c{column}").eqNullSafe(F.col("rep")), "left_semi"))
            return r

        core = evaluate(spark, clause, look)
        least[n] = core.with_frame(core.df.distinct(), distinct=True)  # few rows, so no declaration is relied on
    return Fold(least, found)


def sorts(names: frozenset[str], clauses: list[Clause], facts: Iterable[str], arities: dict[str, int]) -> dict[Place, list[Place]]:
    """Columns whose values meet only each other and come from one column of one input, which is the key."""
    parent: dict[object, object] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def join(a, b):
        parent[root(a)] = root(b)

    places: set[Place] = set()
    widths = dict(arities)
    for k, c in enumerate(clauses):
        atoms = [p.atom if isinstance(p, Not) else p for p in (c.head, *c.body) if not isinstance(p, Compare)]
        if c.grouped or any(a.interval for a in atoms):
            return {}
        fixed = {v for s in c.steps for v in (s.var, *variables(s.call))}
        fixed |= {v for p in c.body if not isinstance(p, Atom) or p.name.startswith(":") for v in variables(p)}
        for a in atoms:
            if a.name.startswith(":"):
                continue
            if widths.setdefault(a.name, len(a.terms)) != len(a.terms):
                return {}
            for i, t in enumerate(a.terms):
                places.add((a.name, i))
                if isinstance(t, Var):
                    join((a.name, i), (k, t.name, "variable"))
                else:
                    fixed |= set(variables(t))
                    join((a.name, i), None)
        for v in fixed:
            join((k, v, "variable"), None)
    for n in facts:
        for i in range(widths.get(n, 0)):
            join((n, i), None)
    by = defaultdict(list)
    for p in places:
        by[root(p)].append(p)
    out = {}
    for r, group in by.items():
        outside = [p for p in group if p[0] not in names]
        if r != root(None) and len(outside) == 1 and max(Counter(n for n, _ in group).values()) == 1:
            out[outside[0]] = group
    return out


def _classes(spark: SparkSession, clause: Clause, lookup: Lookup, column: int) -> tuple[int, int, Classes] | None:
    """The classes of a column of a rule's head, with the premise and its column that the values come from. That column
    must be the declared key of a table, so the bindings of one value are few; the classes are right also where rows break
    the declaration."""
    head, t = clause.head.terms, clause.head.terms[column]
    if clause.steps or clause.head.interval or not isinstance(t, Var) or sum(t.name in variables(x) for x in head) > 1:
        return None
    at = [i for i, p in enumerate(clause.body) if t.name in variables(p)]
    p = clause.body[at[0]]
    if len(at) > 1 or not isinstance(p, Atom) or p.name.startswith(":") or p.interval or p.terms.count(t) != 1 or not all(isinstance(x, Var | Const) for x in p.terms):
        return None
    r, own = lookup(p.name, at[0]), set(variables(p))
    if r.arity != len(p.terms) or r.key is None or any(p.terms[i] != t for i in r.key):
        return None
    tests = [q for q in clause.body if isinstance(q, Compare) and set(variables(q)) <= own]
    rest = {v for q in clause.body if q is not p and q not in tests for v in variables(q)} | set(variables(clause.head))
    links = [v for v in variables(p) if v in rest and v != t.name]
    rows = evaluate(spark, Clause(Atom(p.name, (t, *map(Var, links))), (p, *tests), line=clause.line), lambda name, place: r)
    if rows.kinds[0] not in _VALUES or not set(rows.kinds[1:]) <= _LINKS:
        return None
    seen = F.sort_array(F.collect_set(F.struct(*[f"c{i + 1}" for i in range(len(links))]))) if links else F.min(F.lit(0))
    own = rows.df.groupBy(F.col("c0").alias("value")).agg(seen.alias("seen"))
    sizes = own.groupBy("seen").agg(F.min("value").alias("rep"), F.count(F.lit(1)).alias("n"))
    return at[0], p.terms.index(t), Classes(own.join(sizes.drop("n"), "seen").select("value", "rep"), sizes.select("rep", "n"))
