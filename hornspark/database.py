"""An embedded database: a program over outside tables, with changes, a cache of results, and queries."""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from hornspark.engine import Engine, Program
from hornspark.kinds import Kind
from hornspark.lang.syntax import LanguageError
from hornspark.operators.relation import Relation
from hornspark.sources.store import Log, program_of
from hornspark.sources.tables import fingerprint


class Database:
    """Results are made when asked for and kept until a change.

    cache: a folder that Spark can reach. Results are kept there as Parquet with a manifest; they are used again while
    the program's hash and the fingerprints of all sources are the same. A source without a path makes no cache.
    log: a folder in which changes are kept, a file for each change or batch; a database that is opened with it again
    makes them again.
    """

    def __init__(self, spark: SparkSession, *sources: str, tables: dict[str, Relation | DataFrame] | None = None, paths: dict[str, str] | None = None, cache: str | None = None, log: str | None = None):
        self.spark, self.sources = spark, sources
        self.paths = dict(paths or {})
        self.tables = dict(tables or {})
        self.cache = cache.rstrip("/") if cache and not self.tables else None
        self.log = Log(spark, log) if log else None
        self._changes: list[tuple[str, str, tuple]] = self.log.changes() if self.log else []
        self._batch = 0
        self.reload()

    def reload(self) -> None:
        """Read the sources anew and make the changes again."""
        self.program: Program = Engine(self.spark).program(*self.sources, tables=self.tables | {n: self.spark.read.parquet(p) for n, p in self.paths.items()})
        for what, name, rows in self._changes:
            getattr(self.program, what)(name, *rows)
        self._cached: dict[str, Relation] = {}

    # the cache

    def _key(self) -> str:
        text = json.dumps([self.sources, [(w, n, repr(r)) for w, n, r in self._changes], {n: fingerprint(self.spark, p) for n, p in sorted(self.paths.items())}])
        return hashlib.sha256(text.encode()).hexdigest()

    def _read_text(self, path: str) -> str | None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.text(path, wholetext=True).first().value

    def relation(self, name: str) -> Relation:
        if not self.cache or name not in self.program.heads:
            return self.program.relation(name)
        if name in self._cached:
            return self._cached[name]
        place = f"{self.cache}/{self._key()}/{name}"
        manifest = self._read_text(f"{place}.json")
        if manifest is None:
            r = self.program.relation(name)
            if not r.arity:
                return r
            r.df.write.mode("overwrite").parquet(place)
            text = json.dumps({"kinds": list(map(_kind_json, r.kinds)), "nullable": list(r.nullable), "temporal": r.temporal})
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}.json")
            manifest = text
        m = json.loads(manifest)
        self._cached[name] = Relation(self.spark.read.parquet(place), tuple(map(_kind, m["kinds"])), tuple(m["nullable"]), True, m["temporal"])
        return self._cached[name]

    # queries and changes

    def query(self, atom: str) -> Relation:
        from hornspark.lang.parser import parse_atom

        a = parse_atom(atom)
        if self.cache and a.name in self.program.heads:
            self.program._done.setdefault(a.name, self.relation(a.name))
        return self.program.query(a)

    def relation_names(self) -> list[str]:
        return self.program.relations()

    def insert(self, name: str, *rows: tuple) -> None:
        self._change("insert", name, rows)

    def retract(self, name: str, *rows: tuple) -> None:
        self._change("retract", name, rows)

    def _change(self, what: str, name: str, rows: tuple) -> None:
        self._changes.append((what, name, rows))
        if not self._batch:
            try:
                getattr(self.program, what)(name, *rows)
            except LanguageError:
                self._changes.pop()
                raise
            if self.log:
                self.log.append([(what, name, rows)])
            self._cached.clear()

    @contextlib.contextmanager
    def batch(self) -> Iterator[Database]:
        """Several changes at once; none of them if the block fails."""
        start = len(self._changes)
        self._batch += 1
        try:
            yield self
        except BaseException:
            del self._changes[start:]
            raise
        finally:
            self._batch -= 1
        for what, name, rows in self._changes[start:]:
            getattr(self.program, what)(name, *rows)
        if self.log:
            self.log.append(self._changes[start:])
        self._cached.clear()

    def mutation_log(self) -> str:
        """The changes as a program: facts, and facts of __retract__ relations."""
        return program_of(self._changes)


def _kind_json(k: Kind) -> list:
    return [k.name, [_kind_json(a) for a in k.args], list(k.fields)]


def _kind(x: list) -> Kind:
    return Kind(x[0], tuple(map(_kind, x[1])), tuple(x[2]))
