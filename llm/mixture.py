"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Document rates stay as close to one, in relative entropy, as the targets allow: the
rates are r = min(most, exp(l * size / mean size)) with one multiplier l for each source, which solves the convex dual of
the token constraint. It is found by Newton steps, safeguarded by bisection, each a grouped aggregation over the counts
of documents by source and size; such a table has no more rows for a source than the square root of twice its words.

Rates are then rounded into copies. From the largest size to the smallest, the copies of all documents of one size take
up the words that larger sizes left over or took too many, so that the sum is off by less than the smallest sizes.
Within one size, documents with a smaller hash of their id get the odd copies; large sizes are dealt in parts for this.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from llm.cluster import internal, partitions, saved, ship

#: Copies of a document, and times its size that a source may give, at most.
MOST = 3
#: Steps stop when all sources are within TOLERANCE of their targets, or their brackets cannot be halved any more. That
#: takes some 15 steps outward and 60 halvings at most; more than STEPS is an error.
STEPS, TOLERANCE = 200, 1e-9


def words(text: Column) -> Column:
    """The number of runs of other than ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size -> also target. Sources by code point, nulls last, have these weights, repeating.

    All words are shared by weight; what a source cannot give, at most `most` times its size, the others share in turn.
    This is a level t with target = min(most * size, weight * t): sources stop in the order of size / weight. The table has
    one row for each source; it is sorted in one task, which spills where that is too much to hold.
    """
    every = Window.partitionBy(F.lit(1))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    t = sources.withColumn("w", w.cast("double")).withColumn("cap", most * F.col("source_size").cast("double"))
    by = every.orderBy("stop", "source")
    t = t.withColumn("stop", F.col("cap") / F.col("w")).withColumn("total", F.sum("source_size").over(every).cast("double"))
    # with the first k sources stopped, the rest share what is left at this level
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(every)
    return t.withColumn("at", F.coalesce(level, F.lit(0.0))).select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.col("at")).alias("target"))


def multipliers(sizes: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """source -> l. sizes: source, size, n (documents), x (size over the mean). goal: source, target, source_size.

    A step is one aggregation of words and their slope by source; sources within the tolerance take no part in the next.
    """
    top = math.log(most)
    words_ = F.col("n") * F.col("size")
    weight = sizes.groupBy("source").agg((F.sum(words_ * F.col("x")) / F.sum(words_)).alias("x"))
    both = goal.alias("g").join(weight.alias("w"), F.col("g.source").eqNullSafe(F.col("w.source")), "left").select("g.source", "target", "source_size", "x")
    # what would do if all documents had the size that a word has on average; never too low, as the exponential is convex
    first = F.when(F.col("target") <= 0, -1e300).otherwise(F.least(F.lit(top), F.log(F.col("target") / F.col("source_size"))) / F.col("x"))
    state = saved(both.select("source", "target", first.alias("l"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), (F.col("target") <= 0).alias("done")), "dual")
    found = state.where("done").select("source", "l")
    for _ in range(STEPS):
        live = state.where("not done")
        if live.isEmpty():
            break
        rows = sizes.alias("h").join(live.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).select("h.*", "target", "l", "lo", "hi")
        z = F.col("l") * F.col("x")
        given = words_ * F.exp(F.least(z, F.lit(top)))
        sums = rows.groupBy("source").agg(*[F.first(c).alias(c) for c in ("target", "l", "lo", "hi")], F.sum(given).alias("g"), F.sum(F.when(z < top, given * F.col("x")).otherwise(0.0)).alias("h"))
        off = F.col("g") - F.col("target")
        sums = sums.withColumns({"lo": F.when(off < 0, F.col("l")).otherwise(F.col("lo")), "hi": F.when(off > 0, F.col("l")).otherwise(F.col("hi")), "newton": F.col("l") - off / F.nullif(F.col("h"), F.lit(0.0))})
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")) & (F.abs(F.col("newton") - F.col("l")) < 5)
        # beyond the bracket or far away: halve the bracket, or double outward while one side of it is open
        wide = F.when(F.col("lo") <= -1e4, F.least(F.col("hi") * 2, F.col("hi") - 1)).when(F.col("hi") >= 1e4, F.greatest(F.col("lo") * 2, F.col("lo") + 1)).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = (F.abs(off) <= TOLERANCE * F.col("target")) | ((F.col("hi") - F.col("lo")) <= 1e-13 * F.abs(F.col("l")) + 1e-300)
        state = saved(sums.select("source", "target", F.when(done, F.col("l")).when(inside, F.col("newton")).otherwise(wide).alias("l"), "lo", "hi", done.alias("done")), "dual")
        found = found.unionByName(state.where("done").select("source", "l"))
    else:
        raise ArithmeticError(f"multipliers of some sources did not converge in {STEPS} steps")
    # rounded, so that the order in which sums were added up does not show in the copies
    return found.select("source", F.round("l", 10).alias("l"))


def _round(key, table):
    """Copies of all documents of each size of one source, largest first; what is left over is carried on."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("size", "n", "rate")), strict=True), reverse=True)
    left, copies = 0.0, []
    for size, n, rate in rows:
        want = left + n * rate * size
        k = min(max(math.floor(want / size + 0.5), 0), MOST * n) if size else n * min(MOST, max(0, round(rate)))
        left = want - k * size
        copies.append(k)
    return pa.table({"source": pa.array([key[0].as_py()] * len(rows), pa.string()), "size": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "copies": pa.array(copies, pa.int64())})


def mix(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row for each document: doc_id, source, size (words), source_size, target (of its source), copies, taken (words).

    Null texts and empty ones have size 0, count for nothing and are taken once for what it is worth; null sources are one
    source, the last; null ids and repeated rows are documents of their own and share odd copies in any order. The same
    rows give the same copies in every run. Other columns are left aside. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    parts = max(64, partitions(docs.sparkSession))
    own = internal(docs, doc_id=doc_id, source=source, text=text)
    own = saved(own.select("doc_id", "source", words(F.col("text")).alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")), "sizes")
    bins = saved(own.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), "bins")
    hist = bins.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    goal = saved(targets(totals.select("source", "source_size")), "goal")
    mean = totals.select("source", (F.col("source_size") / F.col("documents")).alias("mean"))
    sizes = hist.where("size > 0").alias("h").join(mean.alias("m"), F.col("h.source").eqNullSafe(F.col("m.source"))).select("h.*", (F.col("size") / F.col("mean")).alias("x"))
    sizes = saved(sizes, "hist")
    l = multipliers(sizes, goal)
    rated = sizes.alias("h").join(l.alias("l"), F.col("h.source").eqNullSafe(F.col("l.source"))).select("h.source", "size", "n", F.least(F.lit(float(MOST)), F.exp(F.col("l") * F.col("x"))).alias("rate"))
    given = rated.groupBy("source").applyInArrow(_round, "source string, size long, n long, copies long")
    # copies of a size to its parts, in proportion, by running sums over the few parts of a size
    in_order = Window.partitionBy("b.source", "b.size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    split = bins.alias("b").join(given.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")) & (F.col("b.size") == F.col("g.size")), "left")
    split = split.select("b.source", "b.size", "part", F.col("b.n").alias("n"), F.col("g.n").alias("all"), F.coalesce("copies", F.col("b.n")).alias("copies"), F.sum("b.n").over(in_order).alias("upto"))
    share = lambda n: F.floor(F.col("copies").cast("decimal(38,0)") * n / F.coalesce("all", F.col("copies")).cast("decimal(38,0)")).cast("long")
    split = split.withColumn("own", F.when(F.col("all").isNull(), F.col("n")).otherwise(share(F.col("upto")) - share(F.col("upto") - F.col("n"))))
    split = split.select("source", "size", "part", "n", "own")
    rank = F.row_number().over(Window.partitionBy("d.source", "d.size", "d.part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    each = own.alias("d").join(split.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.size") == F.col("s.size")) & (F.col("d.part") == F.col("s.part")))
    each = each.select("doc_id", F.col("d.source").alias("source"), F.col("d.size").alias("size"), F.least(F.lit(MOST), F.floor(F.col("own") / F.col("n")) + (rank <= F.col("own") % F.col("n")).cast("long")).alias("copies"))
    return each.alias("e").join(goal.alias("g"), F.col("e.source").eqNullSafe(F.col("g.source"))).select("doc_id", "e.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
