"""Grouping. A group's values are those of the distinct bindings of all variables of the body."""

from __future__ import annotations

from itertools import takewhile

from pyspark.sql import functions as F

from hornspark.functions.registry import double, number
from hornspark.kinds import ANY, FLOAT, NUMBER, Typed, list_of, order_key
from hornspark.lang.syntax import Atom, Call, LanguageError, Var

#: Aggregates for which a value that comes more than once counts as one.
_ONCE = ("fn:max", "fn:min", "fn:collect_distinct", "fn:float:max", "fn:float:min")


def _count(*_):
    return Typed(F.count(F.lit(1)), NUMBER)


def _sum(x):
    return Typed(F.sum(number(x, "fn:sum")), NUMBER)


def _float_sum(x):
    return Typed(F.sum(double(x, "fn:float:sum")), FLOAT)


def _max(x):
    out = F.max_by(x.col, order_key(x)) if x.kind == ANY else F.max(x.col)
    return Typed(F.when(F.count(x.col) == F.count(F.lit(1)), out) if x.nullable else out, x.kind, x.nullable)


def _min(x):
    return Typed(F.min_by(x.col, order_key(x)) if x.kind == ANY else F.min(x.col), x.kind, x.nullable)


def _float_max(x):
    v = double(x, "fn:float:max")
    return Typed(F.coalesce(F.max(F.when(~F.isnan(v), v)), F.max(v)), FLOAT)


def _float_min(x):
    v = double(x, "fn:float:min")
    return Typed(F.coalesce(F.min(F.when(~F.isnan(v), v)), F.min(v)), FLOAT)


def _collect(x):
    """In ascending order; nulls last."""
    got = F.array_sort(F.collect_list(F.struct(x.col.isNull().alias("n"), x.col.alias("v")))) if x.nullable else F.array_sort(F.collect_list(x.col))
    return Typed(F.transform(got, lambda e: e["v"]) if x.nullable else got, list_of(x.kind))


def _collect_distinct(x):
    got = F.array_sort(F.collect_set(F.struct(x.col.isNull().alias("n"), x.col.alias("v")))) if x.nullable else F.array_sort(F.collect_set(x.col))
    return Typed(F.transform(got, lambda e: e["v"]) if x.nullable else got, list_of(x.kind))


AGGREGATES = {
    "fn:count": _count, "fn:sum": _sum, "fn:float:sum": _float_sum, "fn:max": _max, "fn:min": _min, "fn:float:max": _float_max,
    "fn:float:min": _float_min, "fn:collect": _collect, "fn:collect_distinct": _collect_distinct,
}


def group(body, steps: list) -> None:
    """Take the `do` step and the aggregates after it; what is left in steps are functions of keys and results."""
    from hornspark.operators.rules import Slot

    first = steps.pop(0)
    if not isinstance(first.call, Call) or not all(isinstance(a, Var) for a in first.call.args):
        raise body.fail("the keys of a group are variables")
    keys = [a.name for a in first.call.args]
    for k in keys:
        if k not in body.slots:
            raise body.fail(f"key {k} is not bound")
    lets = []
    while steps and isinstance(steps[0].call, Call) and steps[0].call.name in AGGREGATES:
        lets.append(steps.pop(0))
    if not body.distinct and not all(s.call.name in _ONCE for s in lets):
        body.df = body.frame().select(*[s.column for s in body.slots.values()]).distinct()
    made = []
    for s in lets:
        args = [body.term(a) for a in s.call.args]
        try:
            x = AGGREGATES[s.call.name](*args) if s.call.name != "fn:count" else _count()
        except TypeError as e:
            raise LanguageError(f"{s.call.name}: wrong number of arguments") from e
        made.append((s.var, f"a{len(made)}_{s.var}", x))
    cols = [x.col.alias(c) for _, c, x in made]
    if keys:
        grouped = body.frame().groupBy(*dict.fromkeys(body.slots[k].column for k in keys))
        body.df = grouped.agg(*cols) if cols else grouped.agg(F.lit(1).alias("a_none"))
    else:
        # Spark gives a row even where there is nothing to group; here there is no group then
        body.df = body.frame().agg(*cols, F.count(F.lit(1)).alias("a_rows")).where("a_rows > 0").drop("a_rows")
    body.slots = {k: body.slots[k] for k in keys} | {v: Slot(c, x.kind, x.nullable) for v, c, x in made}
    body.distinct, body.telling, body.follows = True, set(keys), []


def count_classes(body, steps: list) -> bool:
    """Where the body is one atom over a relation that is known by classes of values, and groups are counted only: count by
    the sizes of classes, so that no row but those of the groups is made. Says whether that was done."""
    from hornspark.operators.rules import Slot

    clause = body.clause
    if not clause.grouped or len(clause.body) != 1 or not isinstance(clause.body[0], Atom) or clause.body[0].name.startswith(":"):
        return False
    terms = clause.body[0].terms
    r = body.lookup(clause.body[0].name, 0)
    names = [t.name for t in terms if isinstance(t, Var)]
    keys = [getattr(a, "name", None) for a in getattr(steps[0].call, "args", ())]
    lets = list(takewhile(lambda s: isinstance(s.call, Call) and s.call.name in AGGREGATES, steps[1:]))
    if r.folded is None or r.arity != len(terms) or len(set(names)) != len(terms) or not set(keys) <= set(names) or not lets or any(s.call.name != "fn:count" for s in lets):
        return False
    df, weight = r.folded.core.df, F.lit(1).cast("long")
    for i, c in enumerate(r.folded.classes):
        if c and names[i] not in keys:
            df = df.join(c.sizes.select(F.col("rep").alias(f"r{i}"), F.col("n").alias(f"n{i}")), F.col(f"c{i}").eqNullSafe(F.col(f"r{i}")))
            weight = weight * F.col(f"n{i}")
    places = [names.index(k) for k in dict.fromkeys(keys)]
    df = df.groupBy(*[f"c{i}" for i in places]).agg(F.sum(weight).alias("n")).where("n IS NOT NULL")
    body.df = r.folded.expanded(df, places)
    body.slots = {names[i]: Slot(f"c{i}", r.kinds[i], r.nullable[i]) for i in places} | {s.var: Slot("n", NUMBER, False) for s in lets}
    body.distinct, body.telling, body.follows = True, set(keys), []
    del steps[: 1 + len(lets)]
    return True


__all__ = ["AGGREGATES", "count_classes", "group"]
