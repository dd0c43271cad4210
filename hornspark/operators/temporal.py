"""Coalescing of intervals of validity."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from hornspark.kinds import TIME
from hornspark.lang.syntax import LanguageError
from hornspark.operators.relation import Relation


def coalesce(r: Relation) -> Relation:
    """Rows whose last two columns are the bounds of an interval: those that agree in the others and overlap or touch
    become one. Gaps and islands by two windows over one partitioning, so one shuffle."""
    n = r.arity - 2
    if n < 0:
        raise LanguageError("a temporal relation needs two bounds")
    cols = [f"c{i}" for i in range(r.arity)]
    start, end = F.col(cols[n]), F.col(cols[n + 1])
    df = r.df
    for c, k in zip(cols[n:], r.kinds[n:], strict=True):
        if k != TIME:
            df = df.withColumn(c, F.timestamp_micros(F.call_function("div", F.col(c), F.lit(1000).cast("long"))) if k.name == "number" else F.lit(None).cast("timestamp"))
    df = df.where(start.isNotNull() & end.isNotNull())
    by = Window.partitionBy(*cols[:n]) if n else Window.partitionBy(F.lit(0))
    in_order = by.orderBy(start, end)
    before = F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(start <= before, 0).otherwise(1))
    df = df.withColumn("_island", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.groupBy(*cols[:n], "_island").agg(F.min(start).alias(cols[n]), F.max(end).alias(cols[n + 1])).select(*cols)
    return r.with_frame(out, kinds=(*r.kinds[:n], TIME, TIME), distinct=True)
