"""A program over relations that grow by streams.

Rows of a stream are appended, with the number of their micro-batch, to a Parquet table that stands for the relation; a
batch that comes again after a failure replaces its own part, so each row counts once. After each batch the relations
that are watched are evaluated and given to their listeners. They are evaluated anew over all that has come, from ever more
files, so batches should be few and large; relations that nobody watches cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from hornspark.engine import Engine, from_frame
from hornspark.operators.relation import Relation


class Live:
    def __init__(self, spark: SparkSession, *sources: str, folder: str, tables: dict[str, DataFrame | Relation] | None = None):
        self.spark, self.sources, self.folder, self.tables = spark, sources, folder.rstrip("/"), dict(tables or {})
        self.schemas: dict[str, T.StructType] = {}
        self.watched: dict[str, Callable[[Relation], None]] = {}

    def feed(self, name: str, stream: DataFrame, trigger: dict | None = None, checkpoint: str | None = None):
        """Start a query that puts a stream's rows into a relation."""
        self.schemas[name] = stream.schema

        def batch(df: DataFrame, number: int) -> None:
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
            self.update()

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{self.folder}/_checkpoints/{name}").trigger(**(trigger or {"availableNow": True})).start()

    def watch(self, name: str, listener: Callable[[Relation], None]) -> None:
        self.watched[name] = listener

    def program(self):
        program = Engine(self.spark).program(*self.sources, tables=self.tables, check=False)
        for name, schema in self.schemas.items():
            if self._exists(f"{self.folder}/{name}"):
                df = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/*")
            else:
                df = self.spark.createDataFrame([], schema)
            program.bind(name, from_frame(df))
        return program

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def update(self) -> None:
        program = self.program()
        for name, listener in self.watched.items():
            listener(program.relation(name))
