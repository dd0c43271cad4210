"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each task hashes its texts, keeps the distinct fingerprints, splits them by owner (range of the fingerprint), sorts
   them and sends each owner one Golomb-coded list of gaps.
2. An owner merges the lists it got and answers each with a bitmap: which of these fingerprints came more than once.
   Fingerprints sent by one task alone but held by several of its rows are marked by the sender in a bitmap of its own.
3. Lists and bitmaps of one sender go into one file, which the task that reads the same part of the table maps. A row is
   a suspect if its fingerprint is marked there, or is not there at all; so if a part is read by another task than
   before, more rows are suspects and the result is the same. All other rows need no shuffle.
4. Suspects are grouped by their bytes, which verifies them. Grouping combines copies in the task that reads them, so a
   text with a third of all rows reaches its reducer as one row for each task.

Fingerprints of different texts may be equal; that costs a comparison, never a wrong result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from llm.cluster import fresh, internal, partitions, saved, shared_dir, ship
from llm.files import Files, qualified

#: Bits of a fingerprint. With N texts about N / 2**BITS of the others are suspected for nothing.
BITS = 48


def golomb(values: np.ndarray, bits: int = BITS) -> bytes:
    """Sorted distinct values below 2**bits: Rice-coded gaps, that is Golomb codes whose divisor is a power of two."""
    n = len(values)
    if not n:
        return b""
    v = values.astype(np.uint64)
    gaps = np.diff(v, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(v[-1]) / n))))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if k else np.zeros((n, 0), np.uint8)
    head = np.array([n, k, len(unary)], np.int64).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def ungolomb(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, k, m = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    cut = 24 + (m + 7) // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob[24:cut], np.uint8), count=m))
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(blob[cut:], np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        gaps |= (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps)


def fingerprints(texts: pa.Array, bits: int = BITS) -> np.ndarray:
    data = texts.fill_null("").cast(pa.large_binary()) if len(texts) else []
    return np.fromiter((xxhash.xxh3_64_intdigest(t.as_buffer()) >> (64 - bits) for t in data), np.uint64, len(texts))


def exchanged(docs: DataFrame, bits: int = BITS) -> Files:
    """Steps 1 to 3: a file for each task that reads docs (column text), of its fingerprints and what owners say of them."""
    spark = docs.sparkSession
    ship(spark)
    owners = partitions(spark)
    files = Files(f"{qualified(spark, shared_dir(spark))}/replies-{uuid.uuid4().hex}")

    def send(batches):
        # The lists of a task are sent when it has read a few million texts, so its memory is bounded.
        held, count, turn = [], 0, 0

        def flush():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            me = (TaskContext.get().partitionId() << 20) + turn
            owner = (v.astype(np.float64) * (owners / 2.0**bits)).astype(np.int64).clip(0, owners - 1)
            cut = np.searchsorted(owner, np.arange(owners + 1))
            rows = [(me, o, golomb(v[a:b], bits), np.packbits(n[a:b] > 1).tobytes()) for o, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["sender", "owner", "list", "twice"])

        for batch in batches:
            held.append(fingerprints(batch.column(0), bits))
            count += len(held[-1])
            if count >= 2_000_000:
                yield flush()
                held, count, turn = [], 0, turn + 1
        if count:
            yield flush()

    sent = saved(docs.select("text").mapInArrow(send, "sender long, owner int, list binary, twice binary"), "fingerprints")

    def answer(key, table):
        lists = [ungolomb(x.as_py()) for x in table.column("list")]
        twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(v)) for x, v in zip(table.column("twice"), lists, strict=True)]
        v = np.concatenate(lists)
        order = np.argsort(v, kind="stable")
        new = np.concatenate(([True], v[order][1:] != v[order][:-1]))
        group = np.empty(len(v), np.int64)
        group[order] = np.cumsum(new) - 1
        many = np.bincount(group, weights=1.0 + np.concatenate(twice)) > 1
        maps, at = [], 0
        for x in lists:
            maps.append(np.packbits(many[group[at : at + len(x)]]).tobytes())
            at += len(x)
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "bitmap": pa.array(maps, pa.binary())})

    answers = sent.select("sender", "owner", "list", "twice").groupBy("owner").applyInArrow(answer, "sender long, owner int, bitmap binary")

    def deliver(key, lists, bitmaps):
        said = dict(zip(zip(bitmaps.column("sender").to_pylist(), bitmaps.column("owner").to_pylist(), strict=True), bitmaps.column("bitmap").to_pylist(), strict=True))
        v, many = [], []
        for who, o, x in zip(*(lists.column(c).to_pylist() for c in ("sender", "owner", "list")), strict=True):
            v.append(ungolomb(x))
            many.append(np.unpackbits(np.frombuffer(said[who, o], np.uint8), count=len(v[-1])).astype(bool))
        v, at = np.unique(np.concatenate(v), return_index=True)  # owners say the same of a fingerprint in several lists
        files.put(f"reply-{key[0].as_py()}", len(v).to_bytes(8, "little") + v.tobytes() + np.packbits(np.concatenate(many)[at]).tobytes())
        return pa.table({"task": pa.array([key[0].as_py()], pa.int64())})

    task = F.shiftright("sender", 20).alias("task")
    sent.groupBy(task).cogroup(answers.groupBy(task)).applyInArrow(deliver, "task long").count()
    return files


class Suspects:
    """Which fingerprints of one task's rows more than one row may have."""

    def __init__(self, files: Files):
        name = f"reply-{TaskContext.get().partitionId()}"
        self.known, self.many = np.zeros(0, np.uint64), np.zeros(0, bool)
        if files.has(name):
            m = files.map(name)
            n = int.from_bytes(m[:8], "little")
            self.known = np.frombuffer(m, np.uint64, n, 8)
            self.many = np.unpackbits(np.frombuffer(m, np.uint8, -1, 8 + 8 * n), count=n).astype(bool)

    def among(self, v: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(v), bool)
        k = np.minimum(np.searchsorted(self.known, v), len(self.known) - 1)
        return (self.known[k] != v) | self.many[k]


def told_apart(docs: DataFrame, files: Files, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose text another row may have, and those whose text none has."""
    names, flag = docs.columns, fresh(docs, "_suspect")

    def scan(batches):
        suspects = Suspects(files)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(suspects.among(fingerprints(batch.column(names.index("text")), bits)), pa.bool_())], [*names, flag])

    both = docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())]))
    return both.where(F.col(flag)).drop(flag), both.where(~F.col(flag)).drop(flag)


def copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Of equal texts the largest doc_id stays; null
    ids are below all others; rows repeated with the same id and text are one document and share the result. Other
    columns are left aside. An empty table gives an empty result.
    """
    own = internal(docs, doc_id=doc_id, text=text)
    files = exchanged(own.select("text"), bits)

    def digests(batches):
        suspects = Suspects(files)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            sha = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts.cast(pa.large_binary())] if len(texts) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string()), pa.array(suspects.among(fingerprints(texts, bits)), pa.bool_())], ["doc_id", "text_sha256", "suspect"])

    kind = own.schema["doc_id"]
    rows = saved(own.mapInArrow(digests, T.StructType([kind, T.StructField("text_sha256", T.StringType()), T.StructField("suspect", T.BooleanType())])), "digests")
    doubted = told_apart(own, files, bits)[0].select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    groups = doubted.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = saved(groups.where("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    some = rows.where("suspect").select("doc_id", "text_sha256")
    hot = F.col("group_size") >= max(2.0, some.count() / 1000)
    # hot groups, a thousand at most, are broadcast; the others are joined by a shuffle of ids and digests of suspects
    found = some.join(F.broadcast(groups.where(hot)), "text_sha256", "left")
    rest = found.where(F.col("group_size").isNull()).select("doc_id", "text_sha256").join(groups.where(~hot), "text_sha256", "left")
    alone = rows.where("not suspect").select("doc_id", "text_sha256", F.lit(None).cast(kind.dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    cols = ["doc_id", "text_sha256", "keep_id", "group_size"]
    every = found.where(F.col("group_size").isNotNull()).select(cols).unionByName(rest.select(cols)).unionByName(alone)
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return every.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each text that copies() keeps, all its columns as they are. Of rows repeated with the same id and text,
    null ids too, one stays, whichever it is. Only suspects are shuffled, copies of one text combined in the task that
    reads them."""
    names = docs.columns
    suspects, others = told_apart(docs, exchanged(docs.select("text"), bits), bits)
    first = F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.struct(F.col("doc_id").isNotNull(), "doc_id"))
    one = suspects.groupBy(F.coalesce("text", F.lit("")).alias("_text")).agg(first.alias("_row"))
    return others.unionByName(one.select("_row.*"))
