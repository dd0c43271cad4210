"""Programs over the driver's tables, one for each operator of the language, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from hornspark import io_queries
from hornspark.engine import Engine, from_frame

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations")
#: Tables whose rows a key tells apart and which have no nulls: set semantics then need no removal of repeated rows.
KEYED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Those of them whose key is the first column; the rows of lineitem are told apart by all columns.
FIRST = tuple(n for n in KEYED if n != "lineitem")


@dataclass(frozen=True)
class Query:
    """columns: names of the goal's columns; name:2 rounds to two digits."""

    source: str | tuple[str, ...]
    goal: str
    columns: str
    sql: str
    small: bool = True

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = (self.source,) if isinstance(self.source, str) else self.source
        program = Engine(spark).program(*sources, check=False, small=self.small)
        for name in program.undefined & set(TABLES):
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            program.bind(name, from_frame(df, not_null=name in KEYED, distinct=name in KEYED, key=(0,) if name in FIRST else None))
        r = program.query(self.goal)
        cols = []
        for i, c in enumerate(self.columns.split()):
            c, _, digits = c.partition(":")
            cols.append((F.round(f"c{i}", int(digits)) if digits else F.col(f"c{i}")).alias(c))
        return r.df.select(*cols)


_ORDER = "orders(O, C, St, P, D, Pr)"
_LINE = "lineitem(O, Pa, Su, Ln, Q, Ep, Di, T, Rf, Ls, Sh)"
_EVENT = "events(Id, Ts, U, Ty, V, Pp)"

ALL: dict[str, Query] = {
    # flagship
    "flagship_nation_revenue": Query(
        f"rev(N, R) :- customer(C, _, NK, _, _), {_ORDER}, {_LINE}, supplier(Su, _, NK, _), nation(NK, N, RK), region(RK, RN), RN = \"ASIA\", D >= 1994-01-01, D < 1996-01-01, X = fn:float:mult(Ep, fn:float:minus(1.0, Di)) |> do fn:group_by(N); let R = fn:float:sum(X).",
        "rev", "nation revenue:2",
        "SELECT n_name AS nation, round(sum(l_extendedprice * (1.0 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1",
    ),
    "pricing_summary": Query(
        f"q(Rf, Ls, N, SQ, SP) :- {_LINE}, Sh <= 1998-09-02 |> do fn:group_by(Rf, Ls); let N = fn:count(); let SQ = fn:float:sum(Q); let SP = fn:float:sum(Ep).",
        "q", "flag status n qty:2 price:2",
        "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    # scans, filters, projections
    "scan_filter": Query(f'q(O, P) :- {_ORDER}, St = "F", D >= 1995-01-01, P > 200000.0.', "q", "o p", "SELECT DISTINCT o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_totalprice > 200000.0"),
    "scan_constant": Query('q(O) :- orders(O, _, "O", _, _, "1-URGENT").', "q", "o", "SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"),
    "project_distinct": Query("q(B, Z) :- part(_, _, B, _, Z, _).", "q", "brand size", "SELECT DISTINCT p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part"),
    "project_head_expression": Query("q(fn:plus(K, 1), N) :- region(K, N).", "q", "k n", "SELECT CAST(r_regionkey + 1 AS BIGINT) AS k, r_name AS n FROM region"),
    "let_transform": Query(f"q(O, T) :- {_ORDER} |> let T = fn:float:mult(P, 2.0).", "q", "o t", "SELECT DISTINCT o_orderkey AS o, o_totalprice * 2.0 AS t FROM orders"),
    "repeated_variable": Query("q(X) :- lineitem(_, X, X, _, _, _, _, _, _, _, _).", "q", "x", "SELECT DISTINCT l_partkey AS x FROM lineitem WHERE l_partkey = l_suppkey"),
    "compare_operators": Query("q(K, A) :- customer(K, _, N, A, _), A >= 0.0, A < 5000.0, N != 3, N <= 20, K > 10.", "q", "k a", "SELECT c_custkey AS k, c_acctbal AS a FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 5000 AND c_nationkey <> 3 AND c_nationkey <= 20 AND c_custkey > 10"),
    "compare_builtin_predicates": Query("q(K) :- part(K, _, _, _, Z, P), :ge(Z, 10), :lt(Z, 40), :gt(P, 900.0), :le(P, 1500.0).", "q", "k", "SELECT p_partkey AS k FROM part WHERE p_size >= 10 AND p_size < 40 AND p_retailprice > 900 AND p_retailprice <= 1500"),
    "compare_number_float": Query("q(K) :- part(K, _, _, _, Z, _), Z >= 25.5.", "q", "k", "SELECT p_partkey AS k FROM part WHERE p_size >= 25.5"),
    "equal_type_strict": Query("q(K) :- part(K, _, _, _, Z, _), Z = 10.0. q(K) :- part(K, _, _, _, Z, _), Z = 10.", "q", "k", "SELECT p_partkey AS k FROM part WHERE p_size = 10"),
    "mixed_kinds": Query('v(X) :- part(X, _, _, _, _, _). v(X) :- part(_, _, _, _, _, X). v(X) :- part(_, _, X, _, _, _). q(S) :- v(X), X > 1000, X < "Brand#2", S = fn:string:concat(X).', "q", "s", "SELECT CAST(p_partkey AS VARCHAR) AS s FROM part WHERE p_partkey > 1000 UNION SELECT regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') FROM part WHERE p_retailprice > 1000 UNION SELECT p_brand FROM part WHERE p_brand < 'Brand#2'"),
    # joins
    "join_equi": Query("q(C, N, R) :- customer(C, _, NK, _, _), nation(NK, N, RK), region(RK, R).", "q", "c n r", "SELECT c_custkey AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "join_fact": Query(f"q(O, Pr, N) :- {_ORDER}, {_LINE}, Q > 45.0 |> do fn:group_by(O, Pr); let N = fn:count().", "q", "o pr n", "SELECT o_orderkey AS o, o_orderpriority AS pr, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45 GROUP BY 1, 2"),
    "join_multi_key": Query("a(P, S) :- lineitem(_, P, S, _, Q, _, _, _, _, _, _), Q > 40.0. b(P, S) :- lineitem(_, P, S, _, Q, _, _, _, _, _, _), Q < 10.0. q(P, S) :- a(P, S), b(P, S).", "q", "p s", "SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 10"),
    "join_self": Query("q(A, B) :- supplier(A, _, N, _), supplier(B, _, N, _), A < B.", "q", "a b", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey"),
    "join_theta": Query("q(A, B) :- nation(A, _, R), region(B, _), A < B, R != B.", "q", "a b", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(r_regionkey AS BIGINT) AS b FROM nation, region WHERE n_nationkey < r_regionkey AND n_regionkey <> r_regionkey"),
    "join_cross": Query("q(A, B) :- nation(_, A, _), region(_, B).", "q", "a b", "SELECT n_name AS a, r_name AS b FROM nation, region"),
    "join_semi": Query(f'q(C, N) :- customer(C, N, _, _, _), {_ORDER}, St = "P".', "q", "c n", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "join_function_result": Query("q(K, R) :- nation(K, _, RK), X = fn:minus(RK, 1), region(X, R).", "q", "k r", "SELECT CAST(n_nationkey AS BIGINT) AS k, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey - 1"),
    "outer_by_negation": Query(f'has(C) :- {_ORDER}, P > 400000.0. q(C, "big") :- customer(C, _, _, _, _), has(C). q(C, "none") :- customer(C, _, _, _, _), !has(C).', "q", "c k", "SELECT c_custkey AS c, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'big' ELSE 'none' END AS k FROM customer"),
    # negation and sets
    "neg_anti": Query("q(C) :- customer(C, _, _, _, _), !buys(C). buys(C) :- orders(_, C, \"P\", _, _, _).", "q", "c", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "neg_anonymous": Query("q(C) :- customer(C, _, _, _, _), !orders(_, C, \"P\", _, _, _).", "q", "c", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "set_union": Query("q(N) :- customer(_, _, N, _, _). q(N) :- supplier(_, _, N, _).", "q", "n", "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    "set_intersect": Query("q(N) :- c(N), s(N). c(N) :- customer(_, _, N, _, _). s(N) :- supplier(_, _, N, _).", "q", "n", "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "set_except": Query("q(N) :- nation(N, _, _), !s(N). s(N) :- supplier(_, _, N, A), A > 5000.0.", "q", "n", "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"),
    # grouping
    "agg_count": Query(f"q(Ty, N) :- {_EVENT} |> do fn:group_by(Ty); let N = fn:count().", "q", "ty n", "SELECT event_type AS ty, count(*) AS n FROM events GROUP BY 1"),
    "agg_count_bindings": Query("q(Ty, N) :- seen(U, Ty) |> do fn:group_by(Ty); let N = fn:count(U). seen(U, Ty) :- events(_, _, U, Ty, _, _).", "q", "ty n", "SELECT event_type AS ty, count(DISTINCT user_id) AS n FROM events GROUP BY 1"),
    "agg_sum": Query("q(B, S) :- part(_, _, B, _, Z, _) |> do fn:group_by(B); let S = fn:sum(Z).", "q", "b s", "SELECT p_brand AS b, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY 1"),
    "agg_float_sum": Query(f'q(Rf, S) :- {_LINE}, Rf != "N" |> do fn:group_by(Rf); let S = fn:float:sum(Ep).', "q", "f s:2", "SELECT l_returnflag AS f, round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1"),
    "agg_min_max": Query(f"q(C, A, B, X, Y) :- {_ORDER} |> do fn:group_by(C); let A = fn:min(D); let B = fn:max(D); let X = fn:min(Pr); let Y = fn:max(P).", "q", "c a b x y", "SELECT o_custkey AS c, min(o_orderdate) AS a, max(o_orderdate) AS b, min(o_orderpriority) AS x, max(o_totalprice) AS y FROM orders GROUP BY 1"),
    "agg_float_min_max": Query(f"q(Ty, A, B) :- {_EVENT} |> do fn:group_by(Ty); let A = fn:float:min(V); let B = fn:float:max(V).", "q", "ty a b", "SELECT event_type AS ty, min(value) AS a, max(value) AS b FROM events GROUP BY 1"),
    "agg_collect": Query("l(R, L) :- nation(K, _, R) |> do fn:group_by(R); let L = fn:collect(K). q(R, N, A) :- l(R, L), N = fn:list:len(L), A = fn:list:get(L, 0).", "q", "r n a", "SELECT CAST(n_regionkey AS BIGINT) AS r, count(*) AS n, CAST(min(n_nationkey) AS BIGINT) AS a FROM nation GROUP BY 1"),
    "agg_collect_distinct": Query("l(B, L) :- part(_, _, B, T, _, _) |> do fn:group_by(B); let L = fn:collect_distinct(T). q(B, N, A) :- l(B, L), N = fn:len(L), A = fn:list:get(L, 0).", "q", "b n a", "SELECT p_brand AS b, count(DISTINCT p_type) AS n, min(p_type) AS a FROM part GROUP BY 1"),
    "agg_global": Query(f"q(N, S) :- {_LINE} |> do fn:group_by(); let N = fn:count(); let S = fn:float:sum(Q).", "q", "n s:2", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s FROM lineitem"),
    "agg_global_empty": Query(f"q(N) :- {_LINE}, Q < 0.0 |> do fn:group_by(); let N = fn:count().", "q", "n", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0"),
    "agg_average": Query("q(S, M) :- customer(_, _, _, A, S) |> do fn:group_by(S); let T = fn:float:sum(A); let N = fn:count(); let M = fn:float:div(T, N).", "q", "s m:4", "SELECT c_mktsegment AS s, round(avg(c_acctbal), 4) AS m FROM customer GROUP BY 1"),
    "agg_having": Query("n(U, N) :- events(I, _, U, _, _, _) |> do fn:group_by(U); let N = fn:count(I). q(U, N) :- n(U, N), N > 8.", "q", "u n", "SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 8"),
    "agg_distinct_bindings": Query('q(L, N) :- documents(_, _, L, _, _) |> do fn:group_by(L); let N = fn:count().', "q", "l n", "SELECT lang AS l, count(*) AS n FROM (SELECT DISTINCT * FROM documents) GROUP BY 1"),
    "agg_two_rules": Query("a(N, X) :- customer(C, _, N, _, _) |> do fn:group_by(N); let X = fn:count(C). b(N, X) :- supplier(S, _, N, _) |> do fn:group_by(N); let X = fn:count(S). q(N, X, Y) :- a(N, X), b(N, Y).", "q", "n x y", "SELECT CAST(n AS BIGINT) AS n, x, y FROM (SELECT c_nationkey AS n, count(*) AS x FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS n, count(*) AS y FROM supplier GROUP BY 1) USING (n)"),
    # scalars
    "fn_arithmetic": Query("q(K, A, B, C, D, E) :- part(K, _, _, _, Z, _), A = fn:plus(K, Z, 1), B = fn:minus(K, Z), C = fn:mult(Z, 2, 3), D = fn:div(K, 7), E = fn:minus(Z).", "q", "k a b c d e", "SELECT p_partkey AS k, CAST(p_partkey + p_size + 1 AS BIGINT) AS a, CAST(p_partkey - p_size AS BIGINT) AS b, CAST(p_size * 6 AS BIGINT) AS c, CAST(p_partkey // 7 AS BIGINT) AS d, CAST(-p_size AS BIGINT) AS e FROM part"),
    "fn_div_truncates": Query("q(K, D, E) :- part(K, _, _, _, _, _), D = fn:div(fn:minus(K), 7), E = fn:div(1000, fn:plus(K, 1), 3).", "q", "k d e", "SELECT p_partkey AS k, -(p_partkey // 7) AS d, 1000 // (p_partkey + 1) // 3 AS e FROM part"),
    "fn_float": Query("q(K, A, B, C, D) :- part(K, _, _, _, Z, P), A = fn:float:plus(P, 0.5), B = fn:float:minus(P, Z), C = fn:float:mult(P, 2.0), D = fn:float:div(P, 4.0).", "q", "k a:6 b:6 c:6 d:6", "SELECT p_partkey AS k, round(p_retailprice + 0.5, 6) AS a, round(p_retailprice - p_size, 6) AS b, round(p_retailprice * 2.0, 6) AS c, round(p_retailprice / 4.0, 6) AS d FROM part"),
    "fn_sqrt": Query("q(K, S) :- part(K, _, _, _, Z, _), S = fn:sqrt(Z).", "q", "k s:9", "SELECT p_partkey AS k, round(sqrt(p_size), 9) AS s FROM part"),
    "str_starts_with": Query('q(K) :- part(K, _, B, _, _, _), :string:starts_with(B, "Brand#1").', "q", "k", "SELECT p_partkey AS k FROM part WHERE starts_with(p_brand, 'Brand#1')"),
    "str_ends_with": Query('q(K) :- part(K, _, B, _, _, _), :string:ends_with(B, "3").', "q", "k", "SELECT p_partkey AS k FROM part WHERE ends_with(p_brand, '3')"),
    "str_contains": Query('q(K) :- part(K, _, _, T, _, _), :string:contains(T, "E").', "q", "k", "SELECT p_partkey AS k FROM part WHERE contains(p_type, 'E')"),
    "str_concat": Query('q(S) :- nation(K, N, R), S = fn:string:concat(N, "/", K, "/", R).', "q", "s", "SELECT n_name || '/' || n_nationkey || '/' || n_regionkey AS s FROM nation"),
    "str_replace": Query('q(K, A, B, C) :- part(K, _, B0, _, _, _), A = fn:string:replace(B0, "#", "-", -1), B = fn:string:replace(B0, "r", "rr", 1), C = fn:string:replace(B0, "a", "", 0).', "q", "k a b c", "SELECT p_partkey AS k, replace(p_brand, '#', '-') AS a, regexp_replace(p_brand, 'r', 'rr') AS b, p_brand AS c FROM part"),
    "str_conversions": Query("q(K, A, B) :- part(K, _, _, _, Z, P), A = fn:number:to_string(Z), B = fn:float64:to_string(P).", "q", "k a b", "SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS a, regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') AS b FROM part"),
    "name_prefix": Query("kind(/shop/sale, \"purchase\"). kind(/shop/look/click, \"click\"). kind(/shop/look/view, \"view\"). kind(/shopping, \"signup\"). q(S, N) :- kind(K, Ty), :match_prefix(K, /shop/look), S = fn:name:to_string(K), n(Ty, N). n(Ty, N) :- events(I, _, _, Ty, _, _) |> do fn:group_by(Ty); let N = fn:count(I).", "q", "s n", "SELECT '/shop/look/' || event_type AS s, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1"),
    # time
    "time_components": Query(f"q(O, Y, M, Da, H, Mi, S) :- {_ORDER}, Y = fn:time:year(D), M = fn:time:month(D), Da = fn:time:day(D), H = fn:time:hour(D), Mi = fn:time:minute(D), S = fn:time:second(D).", "q", "o y m d h mi s", "SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s FROM orders"),
    "time_arithmetic": Query(f"q(Id, A, B, N) :- {_EVENT}, A = fn:time:add(Ts, 90m), B = fn:time:sub(Ts, 1d), X = fn:time:sub(Ts, 2024-01-01), N = fn:duration:seconds(X).", "q", "id a b n:3", "SELECT event_id AS id, ts + INTERVAL 90 MINUTE AS a, ts - INTERVAL 1 DAY AS b, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0, 3) AS n FROM events"),
    "time_trunc": Query(f"q(T, N) :- {_EVENT}, T = fn:time:trunc(Ts, /hour) |> do fn:group_by(T); let N = fn:count().", "q", "t n", "SELECT date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY 1"),
    "time_format": Query(f'q(Id, A, B, C) :- {_EVENT}, A = fn:time:format(Ts, "/day"), B = fn:time:format(Ts, "/second"), C = fn:time:format_civil(Ts, "+05:30", "/minute").', "q", "id a b c", "SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS a, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS b, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%MZ') AS c FROM events"),
    "time_parse": Query(f'q(Id, A, B) :- {_EVENT}, S = fn:time:format(Ts, "/second"), A = fn:time:parse_rfc3339(S), B = fn:time:parse_civil(S, "-02:00").', "q", "id a b", "SELECT event_id AS id, date_trunc('second', ts) AS a, date_trunc('second', ts) + INTERVAL 2 HOUR AS b FROM events"),
    "time_unix_nanos": Query(f"q(Id, N, T) :- {_EVENT}, N = fn:time:to_unix_nanos(Ts), T = fn:time:from_unix_nanos(N).", "q", "id n t", "SELECT event_id AS id, epoch_ns(ts) AS n, ts AS t FROM events"),
    "time_compare": Query(f"q(Id) :- {_EVENT}, :time:ge(Ts, 2024-01-10), :time:lt(Ts, 2024-01-12T12:00:00Z).", "q", "id", "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 12:00:00'"),
    "duration_functions": Query(f"q(Id, H, M, N) :- {_EVENT}, X = fn:time:sub(Ts, 2024-01-01), Y = fn:duration:add(X, 1h), Z = fn:duration:mult(Y, 2), H = fn:duration:hours(Z), M = fn:duration:minutes(X), N = fn:duration:nanos(Y).", "q", "id h:4 m:4 n", "SELECT event_id AS id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + 3600000000) * 2 / 3600000000.0, 4) AS h, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0, 4) AS m, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + 3600000000) * 1000 AS n FROM events"),
    "duration_compare": Query(f'q(Id) :- {_EVENT}, X = fn:time:sub(Ts, 2024-01-01), :duration:le(X, 48h), Y = fn:duration:parse("1h30m"), :duration:gt(X, Y), X > 7200000000000.', "q", "id", "SELECT event_id AS id FROM events WHERE ts - TIMESTAMP '2024-01-01' <= INTERVAL 48 HOUR AND ts - TIMESTAMP '2024-01-01' > INTERVAL 2 HOUR"),
    # compounds
    "list_functions": Query("q(K, A, N, M) :- part(K, _, _, _, Z, _), L = [K, Z], L2 = fn:list:append(L, 7), A = fn:list:get(L2, 2), N = fn:list:len(L2), M = fn:list:get(L2, 1).", "q", "k a n m", "SELECT p_partkey AS k, CAST(7 AS BIGINT) AS a, CAST(3 AS BIGINT) AS n, CAST(p_size AS BIGINT) AS m FROM part"),
    "list_column": Query("q(I, N, X) :- embeddings(I, E, _), N = fn:list:len(E), X = fn:list:get(E, 0).", "q", "i n x", "SELECT vec_id AS i, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings"),
    "list_member": Query("q(L, N) :- embeddings(_, E, L), :list:member(X, E), X > 0.3 |> do fn:group_by(L); let N = fn:count().", "q", "l n", "SELECT CAST(label AS BIGINT) AS l, count(*) AS n FROM (SELECT DISTINCT label, vec_id, x FROM (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) WHERE x > 0.3 GROUP BY 1"),
    "pair_functions": Query("q(K, A, B) :- nation(K, N, R), P = fn:pair(N, R), A = fn:pair:second(P), B = fn:pair:first(P).", "q", "k a b", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS a, n_name AS b FROM nation"),
    "struct_functions": Query("s(K, {/name: N, /region: R}) :- nation(K, N, R). q(K, A, L) :- s(K, S), A = fn:struct:get(S, /name), L = fn:struct:len(S), :match_field(S, /region, 2).", "q", "k a l", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS a, CAST(2 AS BIGINT) AS l FROM nation WHERE n_regionkey = 2"),
    "map_functions": Query('m(K, ["a": K, "b": R, "a": 5]) :- nation(K, _, R). q(K, A, N, V) :- m(K, M), A = fn:map:get(M, "a"), N = fn:map:len(M), V = fn:list:get(fn:map:values(M), 1).', "q", "k a n v", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey AS BIGINT) AS a, CAST(3 AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS v FROM nation"),
    "map_entries": Query('m(K, ["n": K, "r": R]) :- nation(K, _, R). q(K, E, V) :- m(K, M), :match_entry(M, E, V).', "q", "k e v", "SELECT CAST(n_nationkey AS BIGINT) AS k, 'n' AS e, CAST(n_nationkey AS BIGINT) AS v FROM nation UNION ALL SELECT n_nationkey, 'r', n_regionkey FROM nation"),
    "compound_text": Query("q(K, S) :- nation(K, N, R), S = fn:string:concat([N], {/r: R}, fn:pair(K, 1.5)).", "q", "k s", "SELECT CAST(n_nationkey AS BIGINT) AS k, '[\"' || n_name || '\"]{/r: ' || n_regionkey || '}[' || n_nationkey || ', 1.5]' AS s FROM nation"),
    # recursion
    "rec_linear": Query("e(A, B) :- conversations(C, T, _, _), A = fn:plus(fn:mult(C, 100), T), U = fn:plus(T, 1), conversations(C, U, _, _), B = fn:plus(fn:mult(C, 100), U). q(A, B) :- e(A, B). q(A, C) :- q(A, B), e(B, C).", "q", "a b", "SELECT x.conv_id * 100 + x.turn AS a, y.conv_id * 100 + y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn"),
    "rec_nonlinear": Query("e(A, B) :- supplier(A, _, N, _), supplier(B, _, N, _), B = fn:plus(A, 1). e(A, B) :- part(A, _, _, _, Z, _), B = fn:plus(A, Z), part(B, _, _, _, Z, _). q(A, B) :- e(A, B). q(A, C) :- q(A, B), q(B, C).", "q", "a b", "WITH RECURSIVE e AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND y.s_suppkey = x.s_suppkey + 1 UNION SELECT x.p_partkey, y.p_partkey FROM part x JOIN part y ON y.p_partkey = x.p_partkey + x.p_size AND y.p_size = x.p_size), q AS (SELECT a, b FROM e UNION SELECT q.a, e.b FROM q JOIN e ON q.b = e.a) SELECT a, b FROM q"),
    "rec_mutual": Query("next(A, B) :- nation(A, _, _), nation(B, _, _), B = fn:plus(A, 1). even(0) :- nation(0, _, _). even(B) :- odd(A), next(A, B). odd(B) :- even(A), next(A, B). q(A, \"even\") :- even(A). q(A, \"odd\") :- odd(A).", "q", "a k", "SELECT CAST(n_nationkey AS BIGINT) AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS k FROM nation"),
    "rec_bipartite_reach": Query("e(C, S) :- customer(C, _, N, A, _), supplier(S, _, N, B), A < 0.0, B > 0.0. r(C, S) :- e(C, S). r(C, S) :- r(C, S2), e(C2, S2), e(C2, S). q(C, N) :- r(C, S) |> do fn:group_by(C); let N = fn:count(S).", "q", "c n", "SELECT c_custkey AS c, count(*) AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_acctbal < 0 AND s_acctbal > 0 GROUP BY 1"),
    "rec_counting": Query('up(0, K) :- nation(K, _, 0). up(D, K) :- up(C, K), D = fn:plus(C, 1), D < 5. q(K, M) :- up(D, K) |> do fn:group_by(K); let M = fn:max(D).', "q", "k m", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(4 AS BIGINT) AS m FROM nation WHERE n_regionkey = 0"),
    "rec_negation_strata": Query("e(A, B) :- nation(A, _, R), nation(B, _, R), B = fn:plus(A, 1). r(A, B) :- e(A, B). r(A, C) :- r(A, B), e(B, C). q(A, B) :- nation(A, _, _), nation(B, _, _), A < B, !r(A, B).", "q", "a b", "WITH RECURSIVE e AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND y.n_nationkey = x.n_nationkey + 1), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b FROM nation x, nation y WHERE x.n_nationkey < y.n_nationkey AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = x.n_nationkey AND r.b = y.n_nationkey)"),
    # validity in time
    "temporal_coalesce": Query("active(U)@[S, E] :- events(_, S, U, _, _, _), E = fn:time:add(S, 12h). q(U, S, E) :- active(U)@[S, E].", "q", "u s e", "WITH x AS (SELECT DISTINCT user_id AS u, ts AS s, ts + INTERVAL 12 HOUR AS e FROM events), y AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY u ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x), z AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM y) SELECT u, min(s) AS s, max(e) AS e FROM z GROUP BY u, k"),
    "temporal_points": Query("seen(U)@[T] :- events(_, T, U, \"signup\", _, _). q(U, T) :- seen(U)@[T, T].", "q", "u t", "SELECT DISTINCT user_id AS u, ts AS t FROM events WHERE event_type = 'signup'"),
    "temporal_sequence": Query("a(U)@[T] :- events(_, T, U, \"signup\", _, _). b(U)@[T] :- events(_, T, U, \"purchase\", _, _). q(U) :- a(U)@[S, S], b(U)@[T, T], :time:lt(S, T), X = fn:time:sub(T, S), :duration:le(X, 24h).", "q", "u", "SELECT DISTINCT x.user_id AS u FROM events x JOIN events y ON x.user_id = y.user_id WHERE x.event_type = 'signup' AND y.event_type = 'purchase' AND x.ts < y.ts AND y.ts - x.ts <= INTERVAL 24 HOUR"),
    "temporal_join": Query("a(U)@[S, E] :- events(_, T, U, \"view\", _, _), S = fn:time:trunc(T, /day), E = fn:time:add(S, 1d). b(U)@[S, E] :- events(_, T, U, \"click\", _, _), S = fn:time:trunc(T, /day), E = fn:time:add(S, 1d). q(U, N) :- a(U)@[S, E], b(U)@[S, E] |> do fn:group_by(U); let N = fn:count().", "q", "u n", "WITH d AS (SELECT DISTINCT event_type AS ty, user_id AS u, date_trunc('day', ts) AS s FROM events), g AS (SELECT ty, u, s, s - INTERVAL 1 DAY * row_number() OVER (PARTITION BY ty, u ORDER BY s) AS k FROM d), i AS (SELECT ty, u, min(s) AS s, max(s) AS e FROM g GROUP BY ty, u, k) SELECT x.u, count(*) AS n FROM i x JOIN i y ON x.ty = 'view' AND y.ty = 'click' AND x.u = y.u AND x.s = y.s AND x.e = y.e GROUP BY 1"),
    "temporal_infinite": Query("rule(/open)@[_, _]. rule(/past)@[2024-01-01, 2024-01-10]. q(Id, S) :- rule(N)@[_, _], S = fn:name:to_string(N), events(Id, _, _, \"error\", _, _).", "q", "id s", "SELECT event_id AS id, '/open' AS s FROM events WHERE event_type = 'error'"),
    "temporal_recursion": Query("hop(A, B)@[S, E] :- nation(A, _, _), B = fn:plus(A, 5), nation(B, _, _), S = 2024-01-01, E = 2024-01-05. reach(A, B)@[S, E] :- hop(A, B)@[S, E]. reach(A, C)@[S, E] :- reach(A, B)@[S, E], hop(B, C)@[S, E]. q(A, B, E) :- reach(A, B)@[_S, E].".replace("_S", "S"), "q", "a b e", "SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b, TIMESTAMP '2024-01-05' AS e FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey AND (y.n_nationkey - x.n_nationkey) % 5 = 0"),
    # units, queries
    "packages": Query(("Package geo! place(K, N, R) :- nation(K, N, R), R < 3.", "Package report! Use geo! line(N, C) :- geo.place(K, N, _), customer(C, _, K, _, _)."), "report.line", "n c", "SELECT n_name AS n, c_custkey AS c FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey < 3"),
    "query_atom": Query("by(St, Pr, O) :- orders(O, _, St, _, _, Pr).", 'by("F", "5-LOW", O)', "st pr o", "SELECT o_orderstatus AS st, o_orderpriority AS pr, o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'"),
    "declared_bounds": Query("Decl big(X, Y) bound [/number, /float64] bound [/string, /string]. big(K, P) :- part(K, _, _, _, _, P), P > 950.0.", "big", "k p", "SELECT p_partkey AS k, p_retailprice AS p FROM part WHERE p_retailprice > 950"),
}

_T = "strftime(ts, '{}')"
ALL |= {
    # recursion that runs on Spark however few rows there are
    **{f"{n}_on_spark": replace(ALL[n], small=False) for n in ("rec_linear", "rec_nonlinear", "rec_bipartite_reach", "rec_negation_strata")},
    "rec_mutual_on_spark": Query('next(A, B) :- nation(A, _, _), B = fn:plus(A, 6), nation(B, _, _). even(0) :- nation(0, _, _). even(B) :- odd(A), next(A, B). odd(B) :- even(A), next(A, B). q(A, "even") :- even(A). q(A, "odd") :- odd(A).', "q", "a k", "SELECT CAST(n_nationkey AS BIGINT) AS a, CASE WHEN n_nationkey % 12 = 0 THEN 'even' ELSE 'odd' END AS k FROM nation WHERE n_nationkey % 6 = 0", small=False),
    # literals
    "literal_negative": Query("q(K, A, B) :- nation(K, _, _), A = fn:plus(K, -7), B = fn:float:plus(-1.5, 0.25), K > -1.", "q", "k a b", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey - 7 AS BIGINT) AS a, CAST(-1.25 AS DOUBLE) AS b FROM nation"),
    "literal_escapes": Query(r'q(K, S) :- region(K, N), S = fn:string:concat(N, "\t\x41\u{e9}\\", `raw \n`, ' + "'it')." , "q", "k s", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name || chr(9) || 'A' || chr(233) || chr(92) || 'raw ' || chr(92) || 'n' || 'it' AS s FROM region"),
    "literal_types": Query('Decl l(X, Y) bound [/number, .List</number>]. l(K, [K, R]) :- nation(K, _, R). q(K, N) :- l(K, L), N = fn:len(L).', "q", "k n", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(2 AS BIGINT) AS n FROM nation"),
    # functions
    "map_keys": Query('m(K, ["n": K, "r": R]) :- nation(K, _, R). q(K, A, N) :- m(K, M), L = fn:map:keys(M), A = fn:list:get(L, 1), N = fn:list:len(L).', "q", "k a n", "SELECT CAST(n_nationkey AS BIGINT) AS k, 'r' AS a, CAST(2 AS BIGINT) AS n FROM nation"),
    "struct_values": Query("s(K, {/key: K, /region: R}) :- nation(K, _, R). q(K, A, N) :- s(K, S), L = fn:struct:values(S), A = fn:list:get(L, 1), N = fn:list:len(L).", "q", "k a n", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS a, CAST(2 AS BIGINT) AS n FROM nation"),
    "tuple_functions": Query("q(K, A) :- nation(K, N, R), T = fn:tuple(N, R), A = fn:pair:first(T).", "q", "k a", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS a FROM nation"),
    "struct_get_short": Query("s(K, {/name: N}) :- nation(K, N, _). q(K, A) :- s(K, S), A = fn:struct_get(S, /name).", "q", "k a", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS a FROM nation"),
    "duration_from": Query("q(K, A, B, C, D) :- nation(K, _, _), H = fn:duration:from_hours(K), A = fn:duration:minutes(H), M = fn:duration:from_minutes(K), B = fn:duration:seconds(M), S = fn:duration:from_seconds(K), C = fn:duration:nanos(S), N0 = fn:mult(K, 1000), N = fn:duration:from_nanos(N0), D = fn:duration:nanos(N).", "q", "k a b c d", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey * 60 AS DOUBLE) AS a, CAST(n_nationkey * 60 AS DOUBLE) AS b, CAST(n_nationkey AS BIGINT) * 1000000000 AS c, CAST(n_nationkey AS BIGINT) * 1000 AS d FROM nation"),
    "duration_parse_forms": Query('q(K, A, B, C, D) :- region(K, _), A = fn:duration:nanos(fn:duration:parse("-1h30m")), B = fn:duration:nanos(fn:duration:parse("1.5s")), C = fn:duration:nanos(fn:duration:parse("250ms")), D = fn:duration:nanos(fn:duration:parse("0")).', "q", "k a b c d", "SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(-5400000000000 AS BIGINT) AS a, CAST(1500000000 AS BIGINT) AS b, CAST(250000000 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d FROM region"),
    "time_trunc_units": Query(f"q(Id, A, B, C, D, E) :- {_EVENT}, A = fn:time:trunc(Ts, /microsecond), B = fn:time:trunc(Ts, /millisecond), C = fn:time:trunc(Ts, /second), D = fn:time:trunc(Ts, /minute), E = fn:time:trunc(Ts, /day).", "q", "id a b c d e", "SELECT event_id AS id, date_trunc('microsecond', ts) AS a, date_trunc('millisecond', ts) AS b, date_trunc('second', ts) AS c, date_trunc('minute', ts) AS d, date_trunc('day', ts) AS e FROM events"),
    "time_format_coarse": Query(f'q(Id, A, B, C, D) :- {_EVENT}, A = fn:time:format(Ts, "/year"), B = fn:time:format(Ts, "/month"), C = fn:time:format(Ts, "/hour"), D = fn:time:format(Ts, "/minute").', "q", "id a b c d", f"SELECT event_id AS id, {_T.format('%Y')} AS a, {_T.format('%Y-%m')} AS b, {_T.format('%Y-%m-%dT%HZ')} AS c, {_T.format('%Y-%m-%dT%H:%MZ')} AS d FROM events"),
    "time_format_fine": Query(f'q(Id, A, B) :- {_EVENT}, A = fn:time:format(Ts, "/millisecond"), B = fn:time:format(Ts, "/microsecond").', "q", "id a b", f"SELECT event_id AS id, {_T.format('%Y-%m-%dT%H:%M:%S.%gZ')} AS a, {_T.format('%Y-%m-%dT%H:%M:%S.%fZ')} AS b FROM events"),
    "time_format_civil_units": Query(f'q(Id, A, B, C) :- {_EVENT}, A = fn:time:format_civil(Ts, "-03:00", "/day"), B = fn:time:format_civil(Ts, "UTC", "/second"), C = fn:time:format_civil(Ts, "+01:00", "/hour").', "q", "id a b c", "SELECT event_id AS id, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS a, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS b, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%HZ') AS c FROM events"),
    "time_now": Query(f"q(Id, B) :- {_EVENT}, N = fn:time:now(), :time:gt(N, Ts), B = fn:time:year(Ts).", "q", "id b", "SELECT event_id AS id, year(ts) AS b FROM events WHERE ts < now()::TIMESTAMP"),
    "time_text": Query("t(K, T, D) :- nation(K, _, _), T = fn:time:add(2024-03-01T10:00:00Z, fn:duration:from_hours(K)), D = fn:duration:from_minutes(K). q(K, A, B) :- t(K, T, D), A = fn:string:concat(T), B = fn:string:concat(D).", "q", "k a b", "SELECT CAST(n_nationkey AS BIGINT) AS k, strftime(TIMESTAMP '2024-03-01 10:00:00' + INTERVAL (n_nationkey) HOUR, '%Y-%m-%dT%H:%M:%SZ') AS a, CASE WHEN n_nationkey = 0 THEN '0s' ELSE n_nationkey || 'm0s' END AS b FROM nation"),
    "sqrt_of_negatives": Query("v(K, S) :- nation(K, _, _), S = fn:sqrt(fn:minus(K, 5)). q(K, S) :- v(K, S), S >= 0.0, S < 100.0.", "q", "k s:9", "SELECT CAST(n_nationkey AS BIGINT) AS k, round(sqrt(n_nationkey - 5), 9) AS s FROM nation WHERE n_nationkey >= 5"),
    # aggregates over several kinds
    "agg_mixed_min_max": Query("v(K, X) :- part(K, _, _, _, X, _). v(K, P) :- part(K, _, _, _, _, P). m(K, A, B) :- v(K, X) |> do fn:group_by(K); let A = fn:min(X); let B = fn:max(X). q(K, A, B) :- m(K, X, Y), A = fn:string:concat(X), B = fn:string:concat(Y).", "q", "k a b", "SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS a, regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') AS b FROM part"),
    # intervals that overlap, and one within another
    "temporal_overlap": Query('a(U)@[S, E] :- events(_, S, U, "signup", _, _), E = fn:time:add(S, 12h). b(U)@[S, E] :- events(_, S, U, "purchase", _, _), E = fn:time:add(S, 6h). q(U, S, T) :- a(U)@[S, E], b(U)@[T, F], :time:le(S, F), :time:le(T, E).', "q", "u s t", """WITH x AS (SELECT DISTINCT user_id AS u, event_type AS ty, ts AS s, ts + CASE event_type WHEN 'signup' THEN INTERVAL 12 HOUR ELSE INTERVAL 6 HOUR END AS e FROM events WHERE event_type IN ('signup', 'purchase')),
        y AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY u, ty ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x), z AS (SELECT *, sum(new) OVER (PARTITION BY u, ty ORDER BY s, e) AS g FROM y),
        c AS (SELECT u, ty, min(s) AS s, max(e) AS e FROM z GROUP BY u, ty, g) SELECT DISTINCT a.u, a.s, b.s AS t FROM c a JOIN c b ON a.u = b.u AND a.ty = 'signup' AND b.ty = 'purchase' AND a.s <= b.e AND b.s <= a.e"""),
    "temporal_within": Query('a(U)@[S, E] :- events(_, T, U, "view", _, _), S = fn:time:trunc(T, /day), E = fn:time:add(S, 20h). b(U)@[T] :- events(_, T, U, "purchase", _, _). q(U, T) :- a(U)@[S, E], b(U)@[T, T], :time:le(S, T), :time:le(T, E).', "q", "u t", "WITH a AS (SELECT DISTINCT user_id AS u, date_trunc('day', ts) AS s FROM events WHERE event_type = 'view') SELECT DISTINCT user_id AS u, ts AS t FROM events JOIN a ON u = user_id WHERE event_type = 'purchase' AND ts >= s AND ts <= s + INTERVAL 20 HOUR"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**ALL, **io_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {k: q.sql for k, q in ALL.items()} | io_queries.ORACLE_SQL
