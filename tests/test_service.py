import json
import urllib.error
import urllib.request

from hornspark import Engine
from hornspark.service import Service
from hornspark.snapshots import facts, schema


def call(server, method, path, body=None):
    req = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", json.dumps(body).encode() if body is not None else None, method=method)
    try:
        with urllib.request.urlopen(req, timeout=60) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http(spark):
    server = Service(spark, {"t": spark.createDataFrame([(7,)], "x long")}).serve(port=0)
    try:
        assert call(server, "POST", "/programs", {"name": "a", "source": "p(1). p(2). q(X, /n) :- p(X). d(Y) :- e(Y). u(X) :- t(X)."})[1]["predicates"] == ["d", "e", "p", "q", "t", "u"]
        assert sorted(call(server, "POST", "/query", {"program": "a", "query": "q(X, Y)"})[1]["results"]) == [[1, "/n"], [2, "/n"]]
        assert call(server, "POST", "/query", {"program": "a", "query": "q(2, X)"})[1]["results"] == [[2, "/n"]]
        assert call(server, "POST", "/query", {"program": "a", "query": "u"})[1]["results"] == [[7]]
        call(server, "POST", "/programs/a/insert", {"relation": "e", "tuple": ["x"]})
        assert call(server, "POST", "/query", {"program": "a", "query": "d"})[1]["results"] == [["x"]]
        call(server, "POST", "/programs/a/retract", {"relation": "e", "tuple": ["x"]})
        assert call(server, "POST", "/query", {"program": "a", "query": "d"})[1]["results"] == []
        assert call(server, "GET", "/programs/a")[1]["source"].startswith("p(1)")
        assert len(call(server, "GET", "/programs")[1]["programs"]) == 1
        assert call(server, "POST", "/programs/a/reload", {})[0] == 200 and call(server, "POST", "/admin/reload-all", {})[0] == 200
        assert call(server, "POST", "/eval", {"source": "a(1).", "query": "a"})[1] == {"results": [[1]]}
        assert call(server, "POST", "/eval", {"source": "a(2024-01-01, [1], 90s)."})[1] == {"results": {"a": [["2024-01-01T00:00:00Z", [1], "1m30s"]]}}
        assert call(server, "POST", "/eval", {"source": "a(X) :- b(Y)."})[0] == 400
        assert call(server, "DELETE", "/programs/a")[0] == 200 and call(server, "GET", "/programs/a")[0] == 404
        assert call(server, "GET", "/nowhere")[0] == 404
    finally:
        server.shutdown()


def test_snapshots(spark):
    p = Engine(spark).program("p(1, {/a: 2}). q(X) :- p(X, _), !r(X). r(3).")
    got = json.loads(schema(p))
    assert [(r["name"], r["arity"], r["derived"]) for r in got["relations"]] == [("p", 2, True), ("q", 1, True), ("r", 1, True)]
    assert got["rules"][0]["negated"] == ["r"] and got["rules"][0]["text"].startswith("q(X) :- ")
    assert json.loads(facts(p, ["p"])) == {"p": {"rows": [[1, {"/a": 2}]], "complete": True}}


def test_inclusion(spark):
    p = Engine(spark).program("Decl e(X, Y) inclusion [v(X), v(Y)]. e(1, 2). e(1, 3). v(1). v(2).")
    assert p.violations()["e"].facts() == {(1, 3)}
