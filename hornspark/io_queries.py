"""Queries that write small files of the driver's tables into the shared folder, read them back through the engine, and
change facts; each with SQL over the table that it came from."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hornspark.database import Database
from hornspark.engine import Engine, from_frame
from hornspark.plans.storage import folder
from hornspark.sources import store, tables
from hornspark.sources.folder import read_folder
from hornspark.streaming.live import Live

_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation"
_PLACE = "q(K, N, R) :- t(K, N, R)."


def _scratch(spark: SparkSession) -> str:
    return f"{folder(spark)}/io-{uuid.uuid4().hex}"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("n"), F.col("n_regionkey").cast("long").alias("r"))


def _named(r, columns: str) -> DataFrame:
    return r.df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns.split())])


def _read(table_of: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Write the nations to a folder, bind what reads it, and query that."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _scratch(spark)
        return _named(Engine(spark).program(_PLACE, tables={"t": table_of(spark, _nation(spark, sf_dir), path)}).relation("q"), "k n r")

    return run


def _parquet_folder(spark, df, path):
    df.repartition(3).write.parquet(path)
    return tables.parquet(spark, path)


def _parquet_list(spark, df, path):
    df.repartition(3).write.parquet(path)
    return tables.parquet(spark, *[p for p, _, _ in tables.files(spark, path) if p.endswith(".parquet")])


def _csv(spark, df, path):
    df.write.csv(path)
    return tables.csv(spark, path, "k long, n string, r long")


def _csv_header(spark, df, path):
    df.write.option("header", True).option("sep", ";").csv(path)
    return tables.csv(spark, path, "k long, n string, r long", header=True, separator=";")


def _facts(spark, df, path):
    """As Python values of the size of a program."""
    return [tuple(r) for r in df.collect()]


def _fact_file(form: str, compress: str | None) -> Callable:
    def read(spark, df, path):
        program = Engine(spark).program("nation(K, N, R) :- t(K, N, R).", tables={"t": df})
        store.save(program, path, ["nation"], form=form, compress=compress)
        return tables.rows(spark, store.load(spark, path, form=form)["nation"])

    return read


def _saved_query(spark, df, path):
    program = Engine(spark).program("nation(K, N, R) :- t(K, N, R).", tables={"t": df})
    store.save_query(program, "nation(K, N, R)", path)
    return tables.rows(spark, store.load(spark, path)["nation"])


def _json(spark, df, path):
    import json

    return tables.rows(spark, tables.json_facts(json.dumps({"nation": _facts(spark, df, path)}))["nation"])


def _mgr_folder(spark, df, path):
    program = Engine(spark).program("nation(K, N, R) :- t(K, N, R).", tables={"t": df})
    store.save(program, f"{path}/a.mgr", ["nation"])
    store.save(program, f"{path}/b.mgr.gz", ["nation"], compress="gzip")
    store.write_bytes(spark, f"{path}/c.mg", b'__retract__nation(99, "no", 9). nation(99, "no", 9).')
    return tables.rows(spark, read_folder(spark, path)["nation"])


def _written(spark, df, path):
    """A derived relation written as Parquet and bound again."""
    _named(Engine(spark).program(_PLACE, tables={"t": df}).relation("q"), "k n r").write.parquet(path)
    return from_frame(spark.read.parquet(path))


_READERS = {
    "source_parquet_folder": _parquet_folder, "source_parquet_list": _parquet_list, "source_csv": _csv, "source_csv_header": _csv_header, "source_json": _json,
    "source_python_rows": lambda spark, df, path: tables.rows(spark, _facts(spark, df, path)),
    "source_mgr": _fact_file("rows", None), "source_mgr_gzip": _fact_file("rows", "gzip"), "source_mgr_zstd": _fact_file("rows", "zstd"),
    "source_columns": _fact_file("columns", None), "source_columns_zstd": _fact_file("columns", "zstd"), "source_folder": _mgr_folder,
    "sink_query": _saved_query, "sink_parquet": _written,
}


def source_csv_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a schema all columns are numbers."""
    path = _scratch(spark)
    _nation(spark, sf_dir).select("k", "r").write.csv(path)
    return _named(Engine(spark).program("q(K, R) :- t(K, R), R > 1.", tables={"t": tables.csv(spark, path)}).relation("q"), "k r")


def insert_and_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts stated and taken back; what is derived follows."""
    rows = _facts(spark, _nation(spark, sf_dir), "")
    p = Engine(spark).program("q(K, N) :- place(K, N, R), R < 3.", tables={"place": tables.rows(spark, rows[:10])})
    p.insert("place", *rows[10:], (100, "NOWHERE", 1))
    p.relation("q")
    p.retract("place", (100, "NOWHERE", 1))
    return _named(p.relation("q"), "k n")


def database_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes survive: a second database over the same log makes them again."""
    rows, path = _facts(spark, _nation(spark, sf_dir), ""), _scratch(spark)
    source = "q(K, N) :- place(K, N, R), R < 3. place(100, \"NOWHERE\", 1)."
    first = Database(spark, source, log=f"{path}/log")
    first.insert("place", *rows[:10])
    with first.batch():
        first.insert("place", *rows[10:])
        first.retract("place", (100, "NOWHERE", 1))
    return _named(Database(spark, source, log=f"{path}/log").query("q(K, N)"), "k n")


def database_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second database reads the result that the first wrote."""
    path = _scratch(spark)
    _nation(spark, sf_dir).write.parquet(f"{path}/nation")
    make = lambda: Database(spark, "q(N, R) :- nation(_, N, K), region(K, R).", paths={"nation": f"{path}/nation", "region": f"{sf_dir}/region.parquet"}, cache=f"{path}/cache")
    make().query("q(N, R)")
    return _named(make().query("q(N, R)"), "n r")


def stream_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation fed by a stream of three files."""
    path = _scratch(spark)
    df = _nation(spark, sf_dir)
    df.repartition(3).write.parquet(f"{path}/in")
    live = Live(spark, "q(K, N) :- place(K, N, R), R < 3.", folder=f"{path}/live")
    live.feed("place", spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")).awaitTermination()
    return _named(live.program().relation("q"), "k n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _read(f) for n, f in _READERS.items()} | {
    f.__name__: f for f in (source_csv_numbers, insert_and_retract, database_log, database_cache, stream_relation)
}
_LOW = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation WHERE n_regionkey < 3"
ORACLE_SQL: dict[str, str] = dict.fromkeys(_READERS, _NATION) | {
    "source_csv_numbers": "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r FROM nation WHERE n_regionkey > 1",
    "insert_and_retract": _LOW,
    "database_log": _LOW,
    "stream_relation": _LOW,
    "database_cache": "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey",
}
