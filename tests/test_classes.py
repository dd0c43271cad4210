"""Recursion over classes of values gives what recursion over all values gives, without making all pairs."""

import random

import pytest

from hornspark.engine import Engine, from_frame
from hornspark.lang.parser import parse_unit
from hornspark.plans.classes import sorts

E = "e(C, S) :- a(C, N, X), b(S, N, Y), X < 5, Y > 2. "
REACH = "r(C, S) :- e(C, S). r(C, S) :- r(C, S2), e(C2, S2), e(C2, S). "
COUNTS = "q(C, N) :- r(C, S) |> do fn:group_by(C); let N = fn:count(S). t(N) :- r(C, S) |> do fn:group_by(); let N = fn:count()."
PROGRAMS = {
    "reach": (E + REACH + COUNTS, {0, 1}),
    "other side grouped": (E + REACH + "q(S, N, M) :- r(C, S) |> do fn:group_by(S); let N = fn:count(C); let M = fn:count().", {0, 1}),
    "other aggregates": (E + REACH + "q(C, N, M) :- r(C, S) |> do fn:group_by(C); let N = fn:count(S); let M = fn:max(S).", {0, 1}),
    "a second premise": (E + REACH + "q(C, N) :- r(C, S), a(C, _, 3) |> do fn:group_by(C); let N = fn:count(S).", {0, 1}),
    "column of classes and one without": ("e(C, N, S) :- a(C, N, _), b(S, N, _). r(C, N) :- e(C, N, S). r(C, M) :- r(C, N), a(_, N, M). " + "q(C, K) :- r(C, N) |> do fn:group_by(C); let K = fn:count(N).", {0, 2}),
    "constants": (E + "r(C, S) :- e(C, S). r(C, 3) :- r(C, S2), e(C2, S2), e(C2, S). " + COUNTS, {0}),
    "comparisons": (E + "r(C, S) :- e(C, S), C < 9. r(C, S) :- r(C, S2), e(C2, S2), e(C2, S). " + COUNTS, {1}),
    "negation": (E + "r(C, S) :- e(C, S), !b(S, 0, _). r(C, S) :- r(C, S2), e(C2, S2), e(C2, S). " + COUNTS, {0}),
    "stated rows": (E + "r(1, 2). " + REACH + COUNTS, set()),
    "columns that meet": (E + "r(C, S) :- e(C, S). r(C, S) :- r(C, M), e(M, S). " + COUNTS, set()),
    "one value in two columns": (E + "r(C, C) :- e(C, _). r(C, D) :- r(C, M), e(M, S), e(D, S). q(C, N) :- r(C, S) |> do fn:group_by(C); let N = fn:count(S).", {1}),
    "both columns from one premise": ("e(C, X) :- a(C, N, X), b(_, N, _). r(C, S) :- e(C, S). r(C, S) :- r(C, S2), e(C2, S2), e(C2, S). " + COUNTS, {0}),
    "no other variables": ("e(C, S) :- a(C, _, X), b(S, _, _), X < 5. " + REACH + COUNTS, {0, 1}),
    "two recursive relations": (E + "r(C, S) :- e(C, S). s(C, D) :- r(C, S), e(D, S). r(D, S) :- s(C, D), e(C, S). q(C, N) :- r(C, S) |> do fn:group_by(C); let N = fn:count(S).", {1}),
}


def rows(kind, seed):
    rnd = random.Random(seed)
    keys = range(14) if kind == "keyed" else [rnd.randrange(9) for _ in range(14)]
    return sorted({(k, None if kind == "odd" and rnd.random() < 0.3 else rnd.randrange(5), rnd.randrange(7)) for k in keys}, key=repr)


@pytest.mark.parametrize("kind", ["keyed", "odd"])
@pytest.mark.parametrize("name", PROGRAMS)
def test_as_without_classes(spark, name, kind):
    """odd: tables with nulls, and with repeated values in the column that is declared as their key."""
    source, columns = PROGRAMS[name]
    got = []
    for known in ({"key": (0,)}, {}):
        tables = {n: from_frame(spark.createDataFrame(rows(kind, f"{name}{n}"), "k long, n long, x long"), **known) for n in ("a", "b")}
        p = Engine(spark).program(source, tables=tables, check=False)
        got.append({n: p.relation(n) for n in ("r", "q", "t") if n in p.heads})
    classed, plain = got
    assert bool(classed["r"].folded) == bool(columns and name != "one value in two columns")
    for n in plain:
        assert sorted(map(repr, classed[n].rows())) == sorted(map(repr, plain[n].rows())), n
        assert classed[n].kinds == plain[n].kinds


@pytest.mark.parametrize("name", PROGRAMS)
def test_columns_that_may_have_classes(name):
    source, columns = PROGRAMS[name]
    clauses = parse_unit(source).clauses
    names = frozenset({"r", "s"} & {c.head.name for c in clauses})
    rules = [c for c in clauses if c.head.name in names and c.body]
    facts = {c.head.name for c in clauses if not c.body}
    width = len(clauses[0].head.terms)
    found = sorts(names, rules, facts, {"e": width, "a": 3, "b": 3})
    assert {c for n, c in found if n == "e"} == columns | ({1} if name.startswith("both") else set())  # that column has no key


@pytest.mark.parametrize("small", [True, False])
def test_pairs_are_not_made(spark, small):
    """One class of 20,000 values on either side: 400 million pairs, and 1.6e17 bindings of the recursive rule."""
    n = 20_000
    side = lambda: from_frame(spark.range(n).selectExpr("id", "cast(1 AS long) n", "cast(3 AS long) x"), not_null=True, key=(0,))
    p = Engine(spark).program(E + REACH + COUNTS, tables={"a": side(), "b": side()}, small=small)
    assert p.relation("r").folded.core.df.count() == 1
    assert [tuple(x) for x in p.relation("q").df.selectExpr("count(*)", "min(c1)", "max(c1)").collect()] == [(n, n, n)]
    assert p.relation("t").facts() == {(n * n,)}
