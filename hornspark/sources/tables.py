"""Tables that Spark reads. Row groups and columns are pruned by its readers; nothing is loaded ahead of a query."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import SparkSession

from hornspark.engine import from_frame
from hornspark.lang.syntax import LanguageError
from hornspark.operators.relation import Relation, of_rows
from hornspark.values import Name, kind_of


def parquet(spark: SparkSession, *paths: str, **known) -> Relation:
    """Files, or folders of files, of one schema. known: not_null, distinct."""
    return from_frame(spark.read.parquet(*paths), **known)


def csv(spark: SparkSession, path: str, columns: str = "", *, header: bool = False, separator: str = ",", **known) -> Relation:
    """columns: a Spark schema; without one all columns are numbers. Fields that do not parse are errors."""
    if not columns:
        first = spark.read.option("sep", separator).csv(path).schema
        columns = ", ".join(f"c{i} long" for i in range(len(first)))
    df = spark.read.schema(columns).option("header", header).option("sep", separator).option("mode", "FAILFAST").csv(path)
    return from_frame(df, **known)


def delta(spark: SparkSession, path: str, options: dict[str, str] | None = None, **known) -> Relation:
    """Needs the connector's jars on Spark's class path."""
    try:
        return from_frame(spark.read.format("delta").options(**(options or {})).load(path), **known)
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find" in str(e):
            raise LanguageError("this Spark has no connector for delta tables") from None
        raise


def json_facts(text: str) -> dict[str, list[tuple]]:
    """Facts of the form {relation: [[value, ...], ...]}; {"@name": "/a"} is a name, other objects are structs."""

    def value(v):
        if isinstance(v, dict):
            return Name(v["@name"]) if set(v) == {"@name"} else {k: value(x) for k, x in v.items()}
        return [value(x) for x in v] if isinstance(v, list) else v

    return {name: [tuple(map(value, r)) for r in rows] for name, rows in json.loads(text).items()}


def rows(spark: SparkSession, values: Iterable[tuple]) -> Relation:
    """A relation of Python rows."""
    from functools import reduce

    from hornspark.kinds import BOT, unify

    got = [tuple(r) for r in values]
    width = len(got[0]) if got else 0
    return of_rows(spark, got, tuple(reduce(unify, (kind_of(r[i]) for r in got), BOT) for i in range(width)))


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of each file at or below a path that Spark can reach."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes when any file does."""
    return hashlib.sha256(json.dumps([files(spark, p) for p in paths]).encode()).hexdigest()


__all__ = ["csv", "delta", "files", "fingerprint", "json_facts", "parquet", "rows"]
