"""What the operators share in their use of the cluster: the shared folder, written tables, hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A group with at least this share of all rows is hot; there are at most 1 / HOT_SHARE such groups.
HOT_SHARE = 1 / 1000
#: Rows in a batch for Python, where the session does not say otherwise.
BATCH = 1000
#: Bits of a Bloom filter, at most: 16 MB that the driver assembles and each Python worker holds, however many keys there are.
BLOOM_BITS = 1 << 27
#: The column by which a stage tells rows apart.
ROW = "_row"


def ship(spark: SparkSession) -> None:
    """Send this subpackage to the Python workers, once for each Spark context, which need not have it installed; and bound
    the batches that they get."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        # whole texts go to Python; batches of Spark's default length would be large
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"llm/{name}")
    sc.addPyFile(path)
    sc._llm_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where the cluster names none, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):  # the executors could not see such a folder
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table in the shared folder and read it: cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def internal(df: DataFrame, **columns: str) -> DataFrame:
    """Only these columns, under names of our own, so that others with clashing names do no harm."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> DataFrame:
    """The column ROW added, which no two rows share: doc_id where it names one row, else a number above all ids.

    Only the rows whose id is null or repeated are written, with their numbers, so that these stay as they are.
    """
    ids = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_again"))
    ids = saved(ids, "repeated")
    if ids.isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    own = docs["doc_id"].eqNullSafe(F.col("_again"))
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    again = saved(docs.join(ids, own, "left_semi").withColumn(ROW, F.monotonically_increasing_id() + F.lit(top + 1)), "numbered")
    return docs.join(ids, own, "left_anti").withColumn(ROW, F.col("doc_id").cast("long")).unionByName(again)


def join_hot(left: DataFrame, right: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """Inner join of a table with one row for each key and the number of its rows on the left in column size.

    Keys with a large share of the rows, of which there can be few, are broadcast; the others are shuffled.
    """
    hot = F.col(size) >= max(1.0, total * HOT_SHARE)
    few = right.where(hot)
    many = left.join(F.broadcast(few.select(on)), on, "left_anti").join(right.where(~hot), on)
    return left.join(F.broadcast(few), on).unionByName(many)


def _bloom(keys: DataFrame, on: str) -> tuple[np.ndarray, int]:
    """The bytes of a Bloom filter of these keys, with two places for each, and its bits. Pages of it are made by tasks."""
    bits, n = BLOOM_BITS, keys.count()
    while bits > 1 << 15 and bits >= 64 * n:
        bits >>= 1
    place = F.explode(F.array(*places(on, bits)))
    pages = keys.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("p") % (1 << 15)).alias("m"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in pages.collect():  # BLOOM_BITS at most
        out[r.page] = np.frombuffer(r.m, np.uint8)
    return out.ravel(), bits


def places(on: str, bits: int) -> tuple[Column, Column]:
    h = F.xxhash64(on)
    return h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))


def sieved(df: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """The rows that a Bloom filter of keys (written, distinct) lets pass, which are all whose key is among them and some
    others, and those that it does not. Nothing is shuffled."""
    filled, bits = _bloom(keys, on)
    held = df.sparkSession.sparkContext.broadcast(filled)
    names, maybe, at = df.columns, fresh(df, "_maybe"), [fresh(df, f"_place{i}") for i in (0, 1)]

    def scan(batches):
        for batch in batches:
            ok = np.ones(len(batch), bool)
            for c in (-2, -1):
                at = batch.column(batch.num_columns + c).to_numpy()
                ok &= (held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(ok)], [*names, maybe])

    both = df.select("*", *[p.alias(a) for p, a in zip(places(on, bits), at, strict=True)]).mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField(maybe, T.BooleanType())]))
    return both.where(F.col(maybe)).drop(maybe), both.where(~F.col(maybe)).drop(maybe)


def within(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is in keys (written, distinct). Only those that pass a Bloom filter are joined, so rows of other
    keys are not shuffled, whatever join the sizes ask for."""
    return sieved(df, keys, on)[0].join(keys, on, "left_semi")


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is not in keys (written, distinct), which is not null; those that a Bloom filter rules out stay
    where they are."""
    if keys.isEmpty():
        return df
    passed, others = sieved(df, keys, on)
    return others.unionByName(passed.join(keys, on, "left_anti"))
