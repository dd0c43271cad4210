import gzip
import json
import os
import time

import pytest
from pyspark.sql import types as T

from hornspark import Database, Engine, LanguageError, Name
from hornspark.sources import store, tables
from hornspark.sources.folder import read_folder
from hornspark.sources.formats import read_columns, read_rows, without_retracted, write_columns, write_rows
from hornspark.streaming import Live

FACTS = {"edge": [(1, 2), (2, 3)], "p": [("a b\n\"c'", Name("/x/y"), 1.5)], "c": [([1, 2], {"/f": "x"})], "none": []}


@pytest.mark.parametrize("write, read", [(write_rows, read_rows), (write_columns, read_columns)])
@pytest.mark.parametrize("compress", [None, "gzip", "zstd"])
def test_fact_files(write, read, compress):
    back = read(write(FACTS, compress))
    assert back == FACTS
    assert type(back["p"][0][1]) is Name


def test_fact_file_by_hand():
    assert read_rows(b"2\nedge 2 2\nflag 0 1\nedge(1, 2).\nedge(2,3).\nflag.\n") == {"edge": [(1, 2), (2, 3)], "flag": [()]}
    assert read_columns(gzip.compress(b"1\np 2 2\n1\n2\n/a%20b\n\"x\"\n".replace(b"%20", b"%2E"))) == {"p": [(1, Name("/a.b")), (2, "x")]}
    with pytest.raises(LanguageError):
        read_rows(b"x")
    with pytest.raises(LanguageError):
        read_rows(b"1\nedge 2 2\nedge(1, 2).\n")


def test_retracted_facts():
    assert without_retracted({"p": [(1,), (2,)], "__retract__p": [(1,)]}) == {"p": [(2,)]}


def test_folder(spark, tmp_path):
    (tmp_path / "a.mgr").write_bytes(write_rows({"e": [(1, 2), (1, 2), (2, 3)]}))
    (tmp_path / "b.mg").write_text("e(3, 4). r(X) :- e(X, _). __retract__e(1, 2).")
    got = read_folder(spark, str(tmp_path))
    assert sorted(got["e"]) == [(2, 3), (3, 4)] and got["r"] == [(3,)]


def test_json(spark):
    facts = tables.json_facts('{"p": [[1, "a", {"@name": "/n"}, {"f": [1.5]}]]}')
    assert facts == {"p": [(1, "a", Name("/n"), {"f": [1.5]})]}
    assert Engine(spark).program("q(N) :- p(_, _, N, _).", facts=facts).relation("q").facts() == {(Name("/n"),)}


def test_parquet_and_csv(spark, tmp_path):
    rows = [(1, 50, "US"), (2, 200, "US"), (3, 150, "EU"), (4, 3000, "EU")]
    spark.createDataFrame(rows, "id long, amount long, region string").coalesce(1).write.parquet(str(tmp_path / "o"))
    one = [str(tmp_path / "o" / f) for f in os.listdir(tmp_path / "o") if f.endswith(".parquet")]
    for r in (tables.parquet(spark, str(tmp_path / "o")), tables.parquet(spark, *one)):
        p = Engine(spark).program('q(I) :- o(I, A, "EU"), A > 1000.', tables={"o": r})
        assert p.relation("q").facts() == {(4,)}
    (tmp_path / "n.csv").write_text("1,2\n3,4\n")
    assert tables.csv(spark, str(tmp_path / "n.csv")).facts() == {(1, 2), (3, 4)}
    (tmp_path / "bad.csv").write_text("1,x\n")
    with pytest.raises(Exception):
        tables.csv(spark, str(tmp_path / "bad.csv")).facts()
    with pytest.raises(LanguageError, match="connector"):
        tables.delta(spark, str(tmp_path / "o"))


def test_all_outside_types(spark):
    df = spark.sql("SELECT cast(1 AS tinyint) a, cast(2.5 AS decimal(10,2)) b, date'2024-01-02' c, timestamp_ntz'2024-01-02 03:04:05' d, true e, X'00' f, array(1) g, map('k', 1) h, named_struct('x', 1) i, interval '1' day j")
    r = Engine(spark).program("q(B, C, N, V, X) :- t(_, B, C, _, _, _, G, H, I, _), N = fn:len(G), V = fn:map:get(H, \"k\"), X = fn:struct:get(I, /x).", tables={"t": df}).relation("q")
    (row,) = r.facts()
    assert row[0] == 2.5 and row[2:] == (1, 1, 1)


def test_database(spark, tmp_path):
    path, cache = str(tmp_path / "e"), str(tmp_path / "cache")
    spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").write.parquet(path)
    source = "r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z). n([X], /a, X) :- e(X, _)."
    db = Database(spark, source, paths={"e": path}, cache=cache)
    assert db.relation_names() == ["e", "n", "r"]
    assert db.query("r(1, X)").facts() == {(1, 2), (1, 3)}
    (key,) = os.listdir(cache)
    assert sorted(x for x in os.listdir(f"{cache}/{key}") if not x.startswith(".")) == ["r", "r.json"]
    again = Database(spark, source, paths={"e": path}, cache=cache)
    assert again.relation("r").df.inputFiles()[0].find(key) > 0
    assert again.relation("n").facts() == {("[1]", Name("/a"), 1), ("[2]", Name("/a"), 2)}
    assert again.relation("n").kinds[1].name == "name"
    time.sleep(1.1)
    spark.createDataFrame([(3, 4)], "a long, b long").write.mode("append").parquet(path)
    changed = Database(spark, source, paths={"e": path}, cache=cache)
    assert (1, 4) in changed.query("r").facts()
    db.insert("e", (3, 9))
    assert (1, 9) in db.query("r").facts()
    db.retract("e", (2, 3))
    assert (1, 9) not in db.query("r").facts()
    with db.batch():
        db.insert("e", (2, 3))
        db.retract("e", (3, 9))
    assert (1, 3) in db.query("r").facts()
    with pytest.raises(ZeroDivisionError), db.batch():
        db.insert("e", (50, 51))
        raise ZeroDivisionError
    assert (50, 51) not in db.query("r").facts()
    assert "__retract__e(2, 3)." in db.mutation_log()
    db.reload()
    assert (1, 3) in db.query("r").facts()
    with pytest.raises(LanguageError):
        db.insert("r", (0, 0))


def test_streams(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text(json.dumps({"a": 1, "b": 2}) + "\n")
    live = Live(spark, "r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z).", folder=str(tmp_path / "store"))
    seen = []
    live.watch("r", lambda r: seen.append(r.facts()))

    def feed():
        q = live.feed("e", spark.readStream.schema(schema).json(str(source)))
        q.awaitTermination(60)

    feed()
    (source / "2.json").write_text(json.dumps({"a": 2, "b": 3}) + "\n")
    feed()
    assert seen[0] == {(1, 2)} and seen[-1] == {(1, 2), (2, 3), (1, 3)}


def test_saved_programs(spark, tmp_path):
    p = Engine(spark).program('e(1, "a"). e(2, "b"). q(X) :- e(X, _), X > 1. none(X) :- e(X, _), X > 5.')
    for form in ("rows", "columns"):
        path = f"file://{tmp_path}/{form}.gz"
        store.save(p, path, form=form, compress="gzip")
        assert store.load(spark, path, form=form) == {"e": [(1, "a"), (2, "b")], "none": [], "q": [(2,)]}
        store.save(p, path, ["q"], form=form)
        assert store.load(spark, path, form=form) == {"q": [(2,)]}
    store.save_query(p, 'e(X, "b")', f"{tmp_path}/one")
    assert store.load(spark, f"{tmp_path}/one") == {"e": [(2, "b")]}
    with pytest.raises(LanguageError):
        store.save(p, f"{tmp_path}/x", form="pages")


def test_changes_survive(spark, tmp_path):
    source, log = "q(X) :- e(X, _). e(1, 2).", f"{tmp_path}/log"
    db = Database(spark, source, log=log)
    db.insert("e", (2, 3), (3, 4))
    db.retract("e", (1, 2))
    with pytest.raises(ZeroDivisionError), db.batch():
        db.insert("e", (9, 9))
        raise ZeroDivisionError
    with pytest.raises(LanguageError):
        db.insert("q", (7,))
    with db.batch():
        db.insert("e", (5, 6))
        db.retract("e", (2, 3))
    for again in (Database(spark, source, log=log), db):
        assert again.query("q").facts() == {(3,), (5,)}
    assert len(list((tmp_path / "log").glob("*.mg"))) == 3
