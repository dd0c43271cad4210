"""A folder of fact files (.mgr) and programs (.mg), whose results are facts too."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hornspark.sources.formats import Facts, read_rows, without_retracted
from hornspark.sources.tables import files


def read_folder(spark: SparkSession, path: str) -> Facts:
    """Facts of all files by name, repeated ones once, without those retracted."""
    from hornspark.engine import Engine

    found: Facts = {}
    programs = []
    for name, _, _ in files(spark, path):
        if name.endswith((".mgr", ".mgr.gz")):
            data = bytes(spark.read.format("binaryFile").load(name).first().content)
            for n, rows in read_rows(data).items():
                found.setdefault(n, []).extend(rows)
        elif name.endswith(".mg"):
            programs.append(spark.read.text(name, wholetext=True).first().value)
    for source in programs:
        p = Engine(spark).program(source)
        for n in p.relations():
            found.setdefault(n, []).extend(p.relation(n).rows())
    once = {n: _once(rows) for n, rows in found.items()}
    return without_retracted(once)


def _once(rows: list[tuple]) -> list[tuple]:
    return list({repr(r): r for r in rows}.values())
