"""Relations: DataFrames with positional columns c0, c1, ... and a kind for each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from hornspark.kinds import TIME, Kind, Typed, convert, unify
from hornspark.lang.syntax import LanguageError
from hornspark.values import micros_time, python_value, rows_frame


@dataclass(frozen=True)
class Classes:
    """Values of a column that stand in the same rows. members: each value with the least of its class (rep); sizes: how
    many values (n) each class has."""

    members: DataFrame
    sizes: DataFrame


@dataclass(frozen=True)
class Folded:
    """core: the rows of which each value is the least of its class, in columns that have classes."""

    core: Relation
    classes: tuple[Classes | None, ...]

    def expanded(self, df: DataFrame, columns: Iterable[int]) -> DataFrame:
        """All members of the classes of some columns c0, c1, ... of rows of the core; other columns stay."""
        names = df.columns
        for i in columns:
            if self.classes[i]:
                members = self.classes[i].members.select(F.col("value").alias("m_value"), F.col("rep").alias("m_rep"))
                df = df.join(members, F.col(f"c{i}").eqNullSafe(F.col("m_rep"))).drop(f"c{i}", "m_rep").withColumnRenamed("m_value", f"c{i}")
        return df.select(*names)


@dataclass(frozen=True)
class Relation:
    """distinct: no row comes twice. nullable: which columns may be null. local: the rows, where they are few and known
    without Spark; the DataFrame is then made when it is asked for. key: columns that tell the rows apart, as the caller
    says of a table. folded: the same rows by classes of values."""

    frame: DataFrame | None
    kinds: tuple[Kind, ...]
    nullable: tuple[bool, ...]
    distinct: bool = False
    temporal: bool = False
    local: list[tuple] | None = None
    spark: SparkSession | None = None
    key: tuple[int, ...] | None = None
    folded: Folded | None = None

    @cached_property
    def df(self) -> DataFrame:
        if self.frame is not None:
            return self.frame
        return rows_frame(self.spark, self.local, list(self.kinds)) if self.kinds else self.spark.range(min(1, len(self.local))).select()

    @property
    def arity(self) -> int:
        return len(self.kinds)

    def column(self, i: int) -> Typed:
        return Typed(self.df[f"c{i}"], self.kinds[i], self.nullable[i])

    def as_set(self) -> Relation:
        return self if self.distinct else self.with_frame(self.df.distinct(), distinct=True)

    def with_frame(self, df: DataFrame, **changes) -> Relation:
        return replace(self, frame=df, local=None, key=None, folded=None, **changes)

    def converted(self, kinds: tuple[Kind, ...]) -> Relation:
        if kinds == self.kinds:
            return self
        df = self.df.select(*[convert(F.col(f"c{i}"), a, b).alias(f"c{i}") for i, (a, b) in enumerate(zip(self.kinds, kinds, strict=True))])
        return self.with_frame(df, kinds=kinds)

    def rows(self) -> Iterator[tuple]:
        """All rows as Python values, fetched part by part."""
        if self.local is not None:
            yield from self.local
            return
        df = self.df.select(*[(F.unix_micros(f"c{i}") if k == TIME else F.col(f"c{i}")).alias(f"c{i}") for i, k in enumerate(self.kinds)])
        for r in df.toLocalIterator():
            yield tuple(micros_time(v) if k == TIME else python_value(v, k) for v, k in zip(r, self.kinds, strict=True))

    def facts(self) -> set:
        """All rows as a set; compounds, which Python cannot hash, as their text."""
        return {tuple(v if v is None or v.__hash__ else repr(v) for v in r) for r in self.rows()}

    def named(self, *names: str) -> DataFrame:
        """The DataFrame with names of your own for the columns."""
        if len(names) != self.arity:
            raise LanguageError(f"{self.arity} columns, {len(names)} names")
        return self.df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def empty(spark: SparkSession, kinds: tuple[Kind, ...]) -> Relation:
    return Relation(None, kinds, (False,) * len(kinds), True, local=[], spark=spark)


def of_rows(spark: SparkSession, rows: list[tuple], kinds: tuple[Kind, ...]) -> Relation:
    return Relation(None, kinds, tuple(any(r[i] is None for r in rows) for i in range(len(kinds))), local=rows, spark=spark)


def union(parts: list[Relation]) -> Relation:
    """All rows of relations of one arity, with kinds that hold all."""
    kinds = tuple(reduce(unify, (p.kinds[i] for p in parts)) for i in range(parts[0].arity))
    same = [p.converted(kinds) for p in parts]
    if len(same) == 1:
        return same[0]
    df = reduce(lambda a, b: a.unionByName(b), (p.df for p in same))
    return Relation(df, kinds, tuple(any(p.nullable[i] for p in same) for i in range(len(kinds))), False, any(p.temporal for p in parts))


def minus(a: Relation, b: Relation) -> Relation:
    """Rows of a that are not in b."""
    kinds = tuple(map(unify, a.kinds, b.kinds))
    a, b = a.converted(kinds), b.converted(kinds)
    if not kinds:
        return a if b.df.isEmpty() else a.with_frame(a.df.limit(0))
    right = b.df.select(*[F.col(f"c{i}").alias(f"r{i}") for i in range(len(kinds))])
    on = [F.col(f"c{i}").eqNullSafe(F.col(f"r{i}")) if a.nullable[i] and b.nullable[i] else F.col(f"c{i}") == F.col(f"r{i}") for i in range(len(kinds))]
    return a.with_frame(a.df.join(right, reduce(lambda x, y: x & y, on), "left_anti"))
