"""Small programs and what they give."""

import datetime as dt
import math

import pytest
from hornspark import Engine, LanguageError, Name, derive, evaluate_text
from hornspark.engine import from_frame
from hornspark.lang.parser import parse_atom
from hornspark.values import BEGINNING, FOREVER

T = dt.datetime


def run(spark, source, goal="q", **options):
    sources = (source,) if isinstance(source, str) else source
    return Engine(spark).program(*sources, **options).query(goal).facts()


CASES = {
    "facts and rules": ("p(1). p(2). q(X) :- p(X).", {(1,), (2,)}),
    "let": ("p(1). p(2). q(Y) :- p(X) |> let Y = fn:plus(X, 10).", {(11,), (12,)}),
    "sum": ("p(1, 10). p(1, 20). p(2, 30). q(K, S) :- p(K, V) |> do fn:group_by(K); let S = fn:sum(V).", {(1, 30), (2, 30)}),
    "count": ("p(1, 10). p(1, 20). p(2, 30). q(K, C) :- p(K, V) |> do fn:group_by(K); let C = fn:count(V).", {(1, 2), (2, 1)}),
    "sum of distinct bindings": ("p(1, 10, 1). p(1, 10, 2). q(K, S) :- p(K, V, _) |> do fn:group_by(K); let S = fn:sum(V).", {(1, 20)}),
    "sum over a projection": ("p(1, 10, 1). p(1, 10, 2). r(K, V) :- p(K, V, _). q(K, S) :- r(K, V) |> do fn:group_by(K); let S = fn:sum(V).", {(1, 10)}),
    "two grouping rules": ("p(1, 2). p(3, 4). a(S) :- p(X, _) |> do fn:group_by(); let S = fn:sum(X). b(S) :- p(_, Y) |> do fn:group_by(); let S = fn:sum(Y). q(A, B) :- a(A), b(B).", {(4, 6)}),
    "no group of nothing": ("p(1). r(X) :- p(X), X > 5. q(N) :- r(X) |> do fn:group_by(); let N = fn:count().", set()),
    "let after grouping": ("p(1.0). p(2.0). q(M) :- p(X) |> do fn:group_by(); let S = fn:float:sum(X); let N = fn:count(); let M = fn:float:div(S, N).", {(1.5,)}),
    "max and min of mixed kinds": ('p(1). p(2.5). p("a"). q(A, B) :- p(X) |> do fn:group_by(); let A = fn:min(X); let B = fn:max(X).', {(1, "a")}),
    "collect is sorted": ("p(3, 1). p(1, 2). p(3, 3). q(L, D) :- p(X, _) |> do fn:group_by(); let L = fn:collect(X); let D = fn:collect_distinct(X).", {("[1, 3, 3]", "[1, 3]")}),
    "float max without nan": ("p(1.0, 1). p(4.0, 2). q(A, B) :- p(X, _), Y = fn:sqrt(fn:float:minus(X, 2.0)) |> do fn:group_by(); let A = fn:float:max(Y); let B = fn:float:min(Y).", {(math.sqrt(2), math.sqrt(2))}),
    "names are not strings": ('p(/a). p("/a"). q(X) :- p(X), X = "/a".', {("/a",)}),
    "inequality": ('p("a"). p("b"). q(X) :- p(X), X != "a".', {("b",)}),
    "equality is strict": ("p(1). p(1.0). q(X) :- p(X), X = 1.0.", {(1.0,)}),
    "order crosses kinds": ('p(1). p(2.5). p("x"). p(/n). q(X) :- p(X), X > 2.', {(2.5,), ("x",), (Name("/n"),)}),
    "number and float compare": ("p(1). q(X) :- p(X), X <= 1.0, X >= 1.0.", {(1,)}),
    "joins on mixed kinds": ("a(1). a(1.0). b(1). q(X) :- a(X), b(X).", {(1,)}),
    "negation": ('s("web"). s("db"). h("web"). q(S) :- s(S), !h(S).', {("db",)}),
    "negation before its variable": ('s("web"). s("db"). h("web"). q(S) :- !h(S), s(S).', {("db",)}),
    "negation with anonymous": ("s(1). s(2). h(1, 5). q(S) :- s(S), !h(S, _).", {(2,)}),
    "negation of the undefined": ("s(1). q(S) :- s(S), !nothing(S).", {(1,)}),
    "constants in the second atom": ('a("x"). b("x", 1). b("x", 2). q(X) :- a(X), b(X, 2).', {("x",)}),
    "repeated variable": ("p(1, 1). p(1, 2). q(X) :- p(X, X).", {(1,)}),
    "cross product": ("a(1). a(2). b(3). q(X, Y) :- a(X), b(Y).", {(1, 3), (2, 3)}),
    "existence": ("a(1). b(3). b(4). q(X) :- a(X), b(_).", {(1,)}),
    "no existence": ("a(1). q(X) :- a(X), b(_).", set()),
    "self join": ("e(1, 2). e(2, 3). q(X, Z) :- e(X, Y), e(Y, Z).", {(1, 3)}),
    "projection of a join": ("a(1, 2). a(1, 3). b(2). b(3). q(X) :- a(X, Y), b(Y).", {(1,)}),
    "head without a variable": ("a(1, 2). a(1, 3). q(X, 5) :- a(X, Y), Y > 1.", {(1, 5)}),
    "group without its key": ("p(1, 2). p(2, 2). q(S) :- p(K, V) |> do fn:group_by(K); let S = fn:sum(V).", {(2,)}),
    "self comparison": ("p(1). p(2). p(3). q(X, Y) :- p(X), p(Y), X < Y.", {(1, 2), (1, 3), (2, 3)}),
    "another arity never matches": ("p(1, 2). r(X) :- p(X, _). q(X) :- r(X), X = 1.", {(1,)}),
    "call in a body atom": ("p(1). s(2). q(X) :- p(X), s(fn:plus(X, 1)).", {(1,)}),
    "call in a fact": ("q(fn:plus(1, 2)).", {(3,)}),
    "arithmetic": ("q(A, B, C, D, E, G) :- A = fn:plus(1, 2, 3), B = fn:minus(10, 2, 3), C = fn:mult(2, 3), D = fn:div(fn:minus(7), 2), E = fn:minus(5), G = fn:plus().", {(6, 5, 6, -3, -5, 0)}),
    "division stays zero": ("q(A) :- A = fn:div(1, 2, 0).", {(0,)}),
    "floats": ("q(A, B, C) :- A = fn:float:plus(1, 0.5), B = fn:float:div(2.0), C = fn:sqrt(9).", {(1.5, 0.5, 3.0)}),
    "replace": ('q(A, B, C, D) :- A = fn:string:replace("aXbXc", "X", "-", 1), B = fn:string:replace("aXbXc", "X", "-", -1), C = fn:string:replace("ab", "", "-", -1), D = fn:string:replace("a.b", ".", "$1", 5).', {("a-bXc", "a-b-c", "-a-b-", "a$1b")}),
    "string tests": ('p("foobar"). q(X) :- p(X), :string:starts_with(X, "foo"), :string:ends_with(X, "bar"), :string:contains(X, "oba").', {("foobar",)}),
    "prefixes are strict": ("p(/a). p(/a/b). p(/ab). q(X) :- p(X), :match_prefix(X, /a).", {(Name("/a/b"),), (Name("/ab"),)}),
    "text": ('q(S) :- S = fn:string:concat("a", 1, 2.5, 3.0, /n, ["x", "y"], {/f: 1}, fn:pair(1, "z"), ["k": 2], 90s, 2024-01-02).', {('a12.53/n["x", "y"]{/f: 1}[1, "z"]["k": 2]1m30s2024-01-02T00:00:00Z',)}),
    "float text": ("q(A, B, C, D) :- A = fn:float64:to_string(123456789012.5), B = fn:float64:to_string(0.0000015), C = fn:float64:to_string(1.0), D = fn:float64:to_string(fn:float:mult(1000000.0, 1000000.0)).", {("123456789012.5", "0.0000015", "1", "1000000000000")}),
    "time parts": ("q(A, B, C, D, E, G) :- X = 2024-03-15T10:30:45Z, A = fn:time:year(X), B = fn:time:month(X), C = fn:time:day(X), D = fn:time:hour(X), E = fn:time:minute(X), G = fn:time:second(X).", {(2024, 3, 15, 10, 30, 45)}),
    "time arithmetic": ("q(A, B, C) :- X = 2024-01-01, A = fn:time:add(X, 36h), B = fn:time:sub(X, 1d), C = fn:time:sub(A, B).", {(T(2024, 1, 2, 12), T(2023, 12, 31), dt.timedelta(hours=60))}),
    "trunc floors before 1970": ("q(A) :- A = fn:time:trunc(1969-12-31T23:30:00Z, /hour).", {(T(1969, 12, 31, 23),)}),
    "time formats": ('q(A, B, C) :- X = 2024-01-02T03:04:05.678Z, A = fn:time:format(X, "/millisecond"), B = fn:time:format_civil(X, "-08:00", "/day"), C = fn:time:format(X, "/nanosecond").', {("2024-01-02T03:04:05.678Z", "2024-01-01", "2024-01-02T03:04:05.678Z")}),
    "time parsing": ('q(A, B, C) :- A = fn:time:parse_rfc3339("2024-01-02T03:04:05Z"), B = fn:time:parse_rfc3339("2024-01-02T03:04:05+05:30"), C = fn:time:parse_civil("2024-01-02T03:04:05", "+01:00").', {(T(2024, 1, 2, 3, 4, 5), T(2024, 1, 1, 21, 34, 5), T(2024, 1, 2, 2, 4, 5))}),
    "durations": ('q(A, B, C, D) :- X = fn:duration:parse("-1h30m1.5s"), A = fn:duration:seconds(X), B = fn:duration:nanos(fn:duration:add(1s, 500ms)), C = fn:duration:hours(fn:duration:mult(2, 45m)), D = fn:duration:from_minutes(2).', {(-5401.5, 1_500_000_000, 1.5, dt.timedelta(minutes=2))}),
    "durations and numbers": ("p(5s). q(X) :- p(X), X > 4000000000, :duration:le(X, 5s).", {(dt.timedelta(seconds=5),)}),
    "lists": ("l([10, 20]). q(A, N, L) :- l(X), A = fn:list:get(X, 1), N = fn:len(X), L = fn:list:append(X, 30).", {(20, 2, "[10, 20, 30]")}),
    "list members": ("l([1, 2, 2]). q(X) :- l(L), :list:member(X, L).", {(1,), (2,)}),
    "list member test": ("l([1, 2]). q(L) :- l(L), :list:member(2, L).", {("[1, 2]",)}),
    "pairs": ('q(A, B) :- X = fn:pair(1, "b"), A = fn:pair:second(X), B = fn:pair:first(X).', {("b", 1)}),
    "structs": ('s({/a: 1, /b: "x"}). q(V, N, W) :- s(S), V = fn:struct:get(S, /b), N = fn:struct:len(S), :match_field(S, /a, W).', {("x", 2, 1)}),
    "structs of several shapes": ("s({/a: 1}). s({/a: 2, /b: 3}). q(V) :- s(S), :match_field(S, /b, V).", {(3,)}),
    "maps": ('m(["a": 1, "b": 2, "a": 3]). q(V, N, K) :- m(M), V = fn:map:get(M, "a"), N = fn:map:len(M), K = fn:len(M).', {(1, 3, 6)}),
    "map entries": ('m(["a": 1, "b": 2]). q(K, V) :- m(M), :match_entry(M, K, V).', {("a", 1), ("b", 2)}),
    "compound equality": ("a([1, 2]). a([2, 1]). b([1, 2]). q(X) :- a(X), b(X).", {("[1, 2]",)}),
    "reachability": ("e(1, 2). e(2, 3). e(3, 4). e(4, 5). q(X, Y) :- e(X, Y). q(X, Z) :- q(X, Y), e(Y, Z).", {(a, b) for a in range(1, 6) for b in range(a + 1, 6)}),
    "cycles and two recursive premises": ("e(1, 2). e(2, 3). e(3, 1). e(4, 4). q(X, Y) :- e(X, Y). q(X, Z) :- q(X, Y), q(Y, Z).", {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(4, 4)}),
    "mutual recursion": ("n(0, 1). n(1, 2). n(2, 3). even(0). even(Y) :- odd(X), n(X, Y). odd(Y) :- even(X), n(X, Y). q(X) :- odd(X).", {(1,), (3,)}),
    "recursion with arithmetic": ("q(0). q(Y) :- q(X), Y = fn:plus(X, 1), Y < 5.", {(0,), (1,), (2,), (3,), (4,)}),
    "negation over recursion": ("e(1, 2). e(2, 3). v(1). v(2). v(3). r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z). q(X, Y) :- v(X), v(Y), X < Y, !r(X, Y).", set()),
    "grouping over recursion": ("e(1, 2). e(2, 3). r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z). q(X, N) :- r(X, Y) |> do fn:group_by(X); let N = fn:count(Y).", {(1, 2), (2, 1)}),
    "same generation": ("par(1, 3). par(2, 3). par(4, 1). par(5, 2). q(X, Y) :- par(X, P), par(Y, P). q(X, Y) :- par(X, A), q(A, B), par(Y, B).", {(1, 1), (1, 2), (2, 1), (2, 2), (4, 4), (4, 5), (5, 4), (5, 5)}),
    "time points": ("l(/a)@[2024-01-01]. l(/b)@[2024-01-02]. q(X) :- l(X)@[T, T], T > 2024-01-01.", {(Name("/b"),)}),
    "coalescing": ("s(/x)@[2024-01-01, 2024-01-10]. s(/x)@[2024-01-05, 2024-01-20]. s(/x)@[2024-02-01, 2024-02-02]. s(/y)@[2024-01-01, 2024-01-02]. q(X, S, E) :- s(X)@[S, E].", {(Name("/x"), T(2024, 1, 1), T(2024, 1, 20)), (Name("/x"), T(2024, 2, 1), T(2024, 2, 2)), (Name("/y"), T(2024, 1, 1), T(2024, 1, 2))}),
    "coalescing across a rule": ("l(/a)@[2024-01-01, 2024-01-05]. l(/b)@[2024-01-03, 2024-01-10]. r(/z)@[S, E] :- l(X)@[S, E]. q(S, E) :- r(/z)@[S, E].", {(T(2024, 1, 1), T(2024, 1, 10))}),
    "infinite bounds are values": ("s(/x)@[_, _]. s(/y)@[2024-01-01, _]. q(X) :- s(X)@[_, _].", {(Name("/x"),)}),
    "infinite bounds come out": ("q(/x)@[_, _].", {(Name("/x"), BEGINNING, FOREVER)}),
    "sequence": ("a(/u)@[2024-01-01T00:05:00Z]. b(/u)@[2024-01-01T00:12:00Z]. b(/u)@[2024-01-01T00:30:00Z]. q(X, T) :- a(X)@[S, S], b(X)@[T, T], :time:lt(S, T), D = fn:time:sub(T, S), :duration:le(D, 10m).", {(Name("/u"), T(2024, 1, 1, 0, 12))}),
    "packages": (("Package a! p(8090).", "Package b! Use a! q(X) :- a.p(X)."), {(8090,)}),
    "bounds of alternatives hold together": ('Decl p(X, Y) bound [/number, /string] bound [/string, /number]. Decl q(X, Y) bound [/number, /string] bound [/string, /number]. p(1, "a"). p("b", 2). q(X, Y) :- p(X, Y).', {(1, "a"), ("b", 2)}),
    "bounds in a cycle": ("Decl e(X, Y) bound [/n, /n]. Decl q(X) bound [/n]. e(/n/a, /n/b). e(/n/b, /n/a). r(/n/a). r(Y) :- r(X), e(X, Y). q(X) :- r(X), e(X, _).", {(Name("/n/a"),), (Name("/n/b"),)}),
    "bounds after a test of prefixes": ("Decl p(X) bound [/name]. Decl q(X) bound [/a]. p(/a/x). p(/b/x). q(X) :- p(X), :match_prefix(X, /a).", {(Name("/a/x"),)}),
    "bounds and computed values": ("Decl p(X) bound [/number]. Decl q(X, Y) bound [/number, /number]. p(1). q(X, Y) :- p(X), Y = fn:plus(X, 1).", {(1, 2)}),
    "bounds and aggregates": ("Decl p(X, Y) bound [/a, /string]. Decl q(X, Y) bound [/a, /number]. p(/a/b, \"x\"). q(X, Y) :- p(X, Y0) |> do fn:group_by(X); let Y = fn:count().", {(Name("/a/b"), 1)}),
    "bounds that hold": ("Decl q(X) bound [/number] bound [.List</string>]. q(1).", {(1,)}),
}


@pytest.mark.parametrize("name", CASES)
def test_program(spark, name):
    source, want = CASES[name]
    goal = "b.q" if name == "packages" else "q"
    got = run(spark, source, goal)
    assert got == want
    assert {tuple(map(type, r)) for r in got} == {tuple(map(type, r)) for r in want}


RECURSIVE = [n for n in CASES if "recurs" in n or n in ("reachability", "same generation")]


@pytest.mark.parametrize("name", RECURSIVE)
def test_recursion_on_spark_gives_the_same(spark, name):
    source, want = CASES[name]
    assert run(spark, source, small=False) == want


@pytest.mark.parametrize(
    "source, said",
    [
        ("q(Y) :- p(X), X < Y.", "not bound"),
        ("q(Y) :- p(X).", "not bound"),
        ("q(X) :- !p(X).", "not bound"),
        ("p(1). q(X) :- p(X), Y = fn:nothing(X).", "unknown function"),
        ('p("a"). q(Y) :- p(X), Y = fn:plus(X, 1).', "expected"),
        ("p(1, 2). q(X) :- p(X, Y) |> do fn:group_by(X); let Z = fn:plus(Y, 1).", "not bound"),
        ("p(1). p(1, 2).", "columns"),
        ("Decl p(X) bound [/string]. p(1).", "bounds"),
        ("Decl q(X) bound [/string]. p(1). q(X) :- p(X).", "bounds"),
        ("Decl p(X) bound [/color]. p(/shape/round).", "bounds"),
        ("Decl p(X) bound [.List</number, /string>].", "takes"),
        ("p(1). q(X) :- p(X), :nothing(X).", "unknown predicate"),
        ("Decl p(X) bound [/number]. Decl r(X) bound [/string]. q(X) :- p(X), r(X).", "bounds"),
        ("Decl p(X) bound [/a]. Decl r(X) bound [/ab]. q(X) :- p(X), r(X).", "bounds"),
        ("Decl p(X) bound [/a]. Decl q(X) bound [/b]. q(X) :- p(X).", "bounds"),
        ("Decl p(X) bound [/name]. Decl q(X) bound [/a]. q(X) :- p(X).", "bounds"),
        ("Decl p(X) bound [/number]. q(X) :- X = /a, p(X).", "bounds"),
        ("Decl p(X, Y) bound [/number, /string]. q(X) :- p(X, 1).", "bounds"),
        ("Decl p(X, Y) bound [/number, /string] bound [/string, /number]. q(X) :- p(X, X).", "bounds"),
        ("Decl p(X) bound [/a]. Decl q(X) bound [/b]. r(X) :- p(X). q(X) :- r(X).", "bounds"),
        ('Decl q(X) bound [/string]. r(X) :- p(X). p(1). q(X) :- r(X), X < 3.', "bounds"),
        ("Decl p(X) bound [/a]. Decl q(X) bound [/b]. q(X) :- p(X) |> do fn:group_by(X).", "bounds"),
    ],
)
def test_errors(spark, source, said):
    with pytest.raises(LanguageError, match=said):
        Engine(spark).program(source).relation("q")


def test_run_time_errors(spark):
    for source in ("p(0). q(X) :- p(Y), X = fn:div(1, Y).", "p(0.0). q(X) :- p(Y), X = fn:float:div(1.0, Y).", "l([1]). q(X) :- l(L), X = fn:list:get(L, 3).", 'm(["a": 1]). q(X) :- m(M), X = fn:map:get(M, "b").', "p(9223372036854775807). q(X) :- p(Y), X = fn:plus(Y, 1)."):
        with pytest.raises(Exception, match=r"(?i)zero|range|key|overflow"):
            run(spark, source)


def test_no_fixpoint(spark):
    with pytest.raises(LanguageError, match="no fixpoint"):
        run(spark, "q(0). q(Y) :- q(X), Y = fn:plus(X, 1).", max_rounds=3)


def test_nulls_are_values(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None)], "a int, b int")
    p = Engine(spark).program("same(X, Y) :- t(X, B), t(Y, B), X < Y. big(X) :- t(X, B), B > 3. none(X) :- t(X, B), !has(B). has(B) :- t(2, B). m(M) :- t(_, B) |> do fn:group_by(); let M = fn:max(B).", tables={"t": df})
    assert p.relation("same").facts() == {(1, 3)}
    assert p.relation("big").facts() == {(1,), (2,), (3,)}
    assert p.relation("none").facts() == {(1,), (3,)}
    assert p.relation("m").facts() == {(None,)}


def test_outside_kinds(spark):
    df = spark.createDataFrame([(True, 1.5, "x", [1, 2], {"k": 1})], "a boolean, b float, c string, d array<int>, e map<string,int>")
    p = Engine(spark).program("q(A, B, C, N, V) :- t(A, B, C, D, E), N = fn:len(D), V = fn:map:get(E, \"k\").", tables={"t": df})
    assert p.relation("q").facts() == {(1, 1.5, "x", 2, 1)}


def test_outside_table_with_clauses_is_an_error(spark):
    with pytest.raises(LanguageError, match="outside"):
        Engine(spark).program("t(1).", tables={"t": spark.range(1)})


def test_queries(spark):
    p = Engine(spark).program('p(1, "a"). p(2, "b"). p(3, "a"). e(1, 1). e(1, 2). r(X, Y) :- p(X, Y).')
    assert p.query('r(X, "a")').facts() == {(1, "a"), (3, "a")}
    assert p.query("p(2, _)").facts() == {(2, "b")}
    assert p.query("e(X, X)").facts() == {(1, 1)}
    assert p.query("r").facts() == {(1, "a"), (2, "b"), (3, "a")}


@pytest.mark.parametrize("small", [True, False])
def test_constants_reach_into_recursion(spark, small):
    source = "e(X, Y) :- f(X, Y). r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z). r(90, 91). r(91, 92). s(X, Y) :- e(X, Y). s(X, Z) :- s(X, Y), s(Y, Z)."
    facts = {"f": [(i, i + 1) for i in range(6)]}
    p = Engine(spark).program(source, facts=facts, small=small)
    got = p._demanded(parse_atom("r(3, X)"))
    assert got.facts() == {(3, 4), (3, 5), (3, 6)}
    assert p._demanded(parse_atom("r(X, 3)")) is None and p._demanded(parse_atom("s(3, X)")) is None
    for atom, want in (("r(3, X)", {(3, 4), (3, 5), (3, 6)}), ("r(4, 6)", {(4, 6)}), ("r(90, X)", {(90, 91)}), ("r(77, X)", set()), ("r(X, 2)", {(0, 2), (1, 2)}), ("s(4, X)", {(4, 5), (4, 6)}), ("r(5, X)", {(5, 6)})):
        assert p.query(atom).facts() == want


def test_insert_and_retract(spark):
    p = Engine(spark).program("q(X) :- p(X), !gone(X). base(1). d(X) :- base(X).", facts={"p": [(1,), (2,)]})
    assert p.relation("q").facts() == {(1,), (2,)}
    p.insert("gone", (2,))
    p.insert("p", (3,))
    assert p.relation("q").facts() == {(1,), (3,)}
    p.retract("p", (1,))
    assert p.relation("q").facts() == {(3,)}
    p.insert("base", (5,))
    p.retract("base", (1,))
    assert p.relation("d").facts() == {(5,)}
    with pytest.raises(LanguageError, match="derived"):
        p.insert("q", (9,))


def test_python_values(spark):
    rows = [(Name("/a"), True, 1.5, T(2024, 1, 1), dt.timedelta(hours=1), [1], {"f": "x"})]
    p = Engine(spark).program("q(A, B, C, D, E, X, Y) :- p(A, B, C, D, E, L, S), X = fn:list:get(L, 0), Y = fn:struct:get(S, /f).", facts={"p": rows})
    assert p.relation("q").facts() == {(Name("/a"), 1, 1.5, T(2024, 1, 1), dt.timedelta(hours=1), 1, "x")}


def test_derivations(spark):
    p = Engine(spark).program("e(1, 2). e(2, 3). r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z). lone(X) :- e(X, _), !e(_, X).")
    d = derive(p, "r(1, 3)")
    assert [x.relation for x in d.premises] == ["r", "e"] and d.premises[0].row == (1, 2)
    assert d.premises[0].premises[0].rule is None
    assert derive(p, "r(3, 1)") is None
    assert derive(p, "lone(1)").absent
    assert d.json()["args"] == ["1", "3"]


def test_whole_programs(spark):
    assert evaluate_text(spark, "p(1). q(X) :- p(X), X > 0.") == {"p": {(1,)}, "q": {(1,)}}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    table = lambda n: from_frame(spark.read.parquet(f"{sf}/{n}.parquet"), not_null=True, distinct=True)
    p = Engine(spark).program("q(C) :- customer(C, _, _, _, _), !orders(_, C, _, _, _, _). j(C, N) :- customer(C, _, K, _, _), nation(K, N, _). s(C) :- customer(C, _, _, _, _), orders(_, C, _, _, _, _). f(O, C, D, P, X) :- orders(O, C, \"F\", P, D, X), P > 100.0. g(O) :- orders(O, _, \"F\", P, _, _), P > 100.0. n(S, N) :- customer(C, _, _, _, S) |> do fn:group_by(S); let N = fn:count().", tables={n: table(n) for n in ("customer", "orders", "nation")})
    assert "LeftAnti" in plan(p.relation("q").df)
    assert "LeftSemi" in plan(p.relation("s").df)
    assert "Cartesian" not in plan(p.relation("j").df) and "NestedLoop" not in plan(p.relation("j").df)
    f = plan(p.relation("f").df)
    g = plan(p.relation("g").df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice), EqualTo(o_orderstatus,F)" in g
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in g
    assert plan(p.relation("n").df).count("hashpartitioning") == 1  # keyed rows need no distinct before grouping
    assert "Aggregate" not in f  # nor before a head that has the key
    by = p.query('j(X, "FRANCE")')
    assert "FRANCE" in plan(by.df)


KEYS = {  # whether the keys of tables show that no row comes twice
    "q(A, B) :- supplier(A, _, N, _), supplier(B, _, N, _), A < B.": True,
    "q(C, M) :- customer(C, _, N, _, _), nation(N, M, _).": True,
    "q(O, M) :- orders(O, C, _, _, _, _), customer(C, _, N, _, _), nation(N, M, _).": True,
    "q(K, R) :- nation(K, _, RK), X = fn:minus(RK, 1), region(X, R).": True,
    "q(A, B) :- nation(A, _, R), region(R, B), supplier(S, _, A, _).": None,
    "q(B) :- supplier(A, _, N, _), supplier(B, _, N, _), A < B.": False,
    "q(N, M) :- customer(C, _, N, _, _), nation(N, M, R), region(R, _).": False,
    "q(A, N) :- customer(A, _, N, _, _), supplier(_, _, N, X), X > 0.0, orders(_, A, _, Y, _, _), Y > X.": False,
    "q(A, B) :- nation(A, _, R), supplier(_, _, A, X), nation(B, _, R), supplier(_, _, B, Y), X < Y.": False,
    "q(R, M) :- nation(K, _, R) |> do fn:group_by(R); let M = fn:max(K).": None,
}


@pytest.mark.parametrize("rule", KEYS)
def test_keys_tell_whether_rows_come_twice(spark, sf, rule):
    table = lambda n, key: from_frame(spark.read.parquet(f"{sf}/{n}.parquet"), not_null=True, distinct=True, key=key)
    got, want = (Engine(spark).program(rule, tables={n: table(n, key) for n in ("customer", "orders", "nation", "region", "supplier")}).relation("q") for key in ((0,), None))
    if KEYS[rule] is not None:
        assert ("Aggregate" not in plan(got.df)) == KEYS[rule]
    rows = list(got.rows())
    assert len(rows) == len(set(rows)) and set(rows) == want.facts()


def test_rows_are_dealt_out_before_pairs_are_made(spark, sf):
    table = lambda n: from_frame(spark.read.parquet(f"{sf}/{n}.parquet"), not_null=True, key=(0,))
    p = Engine(spark).program("q(A, B) :- supplier(A, _, N, _), supplier(B, _, N, _), A < B. c(C, M) :- customer(C, _, N, _, _), nation(N, M, _). o(C, O) :- customer(C, _, _, _, _), orders(O, C, _, _, _, _).", tables={n: table(n) for n in ("customer", "nation", "orders", "supplier")})
    assert [plan(p.relation(n).df).count("REPARTITION_BY_NUM") for n in "qco"] == [1, 0, 0]


def test_cross_kind_filters_reach_the_scan(spark, sf):
    p = Engine(spark).program("q(O) :- orders(O, _, _, _, D, _), D >= 1995-01-01.", tables={"orders": from_frame(spark.read.parquet(f"{sf}/orders.parquet"), not_null=True)})
    assert "GreaterThanOrEqual(o_orderdate" in plan(p.relation("q").df)


def test_derivations_do_not_rest_on_themselves(spark):
    """Many neighbours that are reached only through the node itself, and one real path."""
    edges = "".join(f"edge(/z, /a{i}). edge(/a{i}, /z). " for i in range(12))
    p = Engine(spark).program(f"start(/zz). {edges} edge(/zz, /z). r(X) :- start(X). r(Y) :- r(X), edge(X, Y).")

    def proved(d, above):
        assert (d.relation, d.row) not in above and d.cut is None
        for x in d.premises:
            proved(x, (*above, (d.relation, d.row)))

    d = derive(p, "r(/z)")
    proved(d, ())
    assert d.premises[0].row == ("/zz",)
    below = derive(p, "r(/a3)")
    proved(below, ())


def test_kinds_follow_what_is_bound(spark):
    p = Engine(spark).program("q(X, Y) :- t(X, Y).")
    assert [k.name for k in p.kinds("q")] == ["bot", "bot"]
    p.bind("t", spark.createDataFrame([(1, "a")], "a long, b string"))
    assert [k.name for k in p.kinds("q")] == ["number", "string"]
    p.insert("t", (2, "b"))
    assert [k.name for k in p.kinds("q")] == ["number", "string"]


def test_bindings_on_the_driver_are_bounded(spark, monkeypatch):
    from hornspark.plans import local

    monkeypatch.setattr(local, "DERIVED", 1000)
    source = "r(X) :- a(X, _). r(Y) :- r(X), a(X, K), b(K, Y)."
    facts = {"a": [(i, 0) for i in range(60)], "b": [(0, i) for i in range(60)]}
    assert Engine(spark).program(source, facts=facts).relation("r").facts() == {(i,) for i in range(60)}


def test_outside_tables_keep_declared_bounds(spark):
    df = spark.createDataFrame([(1, "a")], "a long, b string")
    for bounds, fits in (("[/number, /string]", True), ("[/string, /string]", False), ("[/string, /string] bound [/number, /string]", True), ("[/number, /number]", False)):
        source = f"Decl t(X, Y) bound {bounds}. q(X) :- t(X, _)."
        if fits:
            assert Engine(spark).program(source, tables={"t": df}).relation("q").facts() == {(1,)}
        else:
            with pytest.raises(LanguageError, match="bounds"):
                Engine(spark).program(source, tables={"t": df})
            assert Engine(spark).program(source, tables={"t": df}, check_bounds=False).relation("q").facts() == {(1,)}
