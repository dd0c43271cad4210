"""Benchmark decontamination with a broadcast hash set of n-grams.

Benchmark items are cut into windows of n words (a shorter item, if it has words, is one window). The hashes of the
windows of a block of items are broadcast, sorted; each task slides over the words of its documents, looks their window
hashes up, and compares the words of every hit with the item's before it counts. A block has at most `block` windows
(but at least one item), and one block at a time is read from the benchmark, broadcast and given up again, so what the
driver and the tasks hold is bounded however large the benchmark is: each further block is a further pass over the
documents, which writes only the rows that it hits. Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.cluster import ROW, internal, keyed, saved, ship
from llm.text import pieces, windows, words

#: Windows in one broadcast: at most about 100 MB with their words.
BLOCK = 500_000


class Grams:
    """Windows of some items: sorted hashes by length, and for each the items and the words to compare with."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        found: dict[int, dict[bytes, set]] = {}
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        w = words(texts, "plain", lower=True)
        for i, (item, _) in enumerate(items):
            own = [w.word(k) for k in range(w.first[i], w.first[i + 1])]
            size = min(n, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                found.setdefault(size, {}).setdefault(b" ".join(own[k : k + size]), set()).add(item)
        self.tables = []
        for size, grams in sorted(found.items()):
            keys = list(grams)
            g = words(pa.array([x.decode() for x in keys], pa.large_string()), "plain")
            h, at = windows(g.hashes(), g.first, size)
            assert len(at) == len(keys)
            order = np.argsort(h, kind="stable")
            self.tables.append((size, h[order], [keys[i] for i in order], [sorted(x for x in grams[keys[i]] if x is not None) for i in order]))

    def __len__(self) -> int:
        return sum(len(t[1]) for t in self.tables)


def blocks(items: Iterable[tuple[object, str]], n: int, most: int) -> Iterator[Grams]:
    """The windows of these items in blocks of at most so many, or of one item."""
    now, size = [], 0
    for item in items:
        w = len(words(pa.array([item[1] or ""], pa.large_string()), "plain", lower=True))
        grows = max(w - n + 1, min(w, 1))
        if now and size + grows > most:
            yield Grams(now, n)
            now, size = [], 0
        now.append(item)
        size += grows
    if now:
        yield Grams(now, n)


def benchmark_blocks(benchmark: DataFrame, n: int, block: int, item_text: str = "text", item_id: str = "item_id") -> Iterator[Grams]:
    """The driver reads the benchmark part by part and holds one block."""
    rows = internal(benchmark, item=item_id, words=item_text).select(F.col("item").cast("string"), "words").toLocalIterator()
    return blocks(((r.item, r.words) for r in rows), n, block)


def hits(w, h: np.ndarray, grams: Grams):
    """(start, length, items) of each verified occurrence."""
    for size, keys, texts, items in grams.tables:
        got, at = windows(h, w.first, size)
        if not len(got):
            continue
        k = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
        for j in np.flatnonzero(keys[k] == got):
            start, key = int(at[j]), int(k[j])
            seen = b" ".join(w.word(i) for i in range(start, start + size))
            while key < len(keys) and keys[key] == got[j]:
                if texts[key] == seen:
                    yield start, size, items[key]
                key += 1


SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, item_ids array<string>"


def _hit(w, grams: Grams) -> tuple[np.ndarray, dict[int, set]]:
    """Which words lie in a window, and the items by text."""
    hit, owner, named = np.zeros(len(w) + 1, np.int32), w.text_of(), {}
    for start, size, items in hits(w, w.hashes(), grams):
        hit[start] += 1
        hit[start + size] -= 1
        named.setdefault(int(owner[start]), set()).update(items)
    return np.cumsum(hit[:-1]) > 0, named


def _scanned(docs: DataFrame, grams: Grams, only_hits: bool) -> DataFrame:
    """docs: doc_id, text. What one block says of each document, or of those that it hits."""
    held = docs.sparkSession.sparkContext.broadcast(grams)

    def scan(batches):
        for batch in batches:
            for i, j in pieces(batch.column(1)):
                part = batch.slice(i, j - i)
                w = words(part.column(1), "plain", lower=True)
                inside, named = _hit(w, held.value)
                spans = [[] for _ in range(j - i)]
                for d in {int(x) for x in w.text_of()[inside]}:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside[w.first[d] : w.first[d + 1]].astype(np.int8), [0]))))
                    spans[d] = [{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(w.first), pa.int64()), pa.array(spans, _SPANS), pa.array([sorted(named.get(d, ())) for d in range(j - i)], pa.list_(pa.string()))],
                    ["doc_id", "n_words", "spans", "item_ids"],
                )
                yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hits else out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], s["stop"])
        else:
            out.append(dict(s))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block: int = BLOCK) -> DataFrame:
    """One row for each document: n_words, the spans of words inside any benchmark window (merged, stop exclusive),
    and the ids of the items that occur, sorted as strings.

    Null and empty texts have no words and no hits; items without words match nothing; an item with a null id still
    marks spans but is not listed; repeated rows give repeated results; an empty benchmark marks nothing. Other columns
    are left aside, whatever their names.
    """
    ship(docs.sparkSession)
    own = internal(docs, doc_id=doc_id, text=text)
    each = benchmark_blocks(benchmark, n, block, item_text, item_id)
    first, second = next(each, Grams([], n)), next(each, None)
    if second is None:
        return _scanned(own, first, False)
    # more than one block: rows need numbers, by which what the passes find of them is brought together
    own = keyed(own)
    ids, texts = own.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id")), own.select(F.col(ROW).alias("doc_id"), "text")
    base = saved(_scanned(texts, first, False), "first-block")
    found = [base.where(F.size("spans") > 0)]
    while second is not None:
        found.append(saved(_scanned(texts, second, True), "block"))
        second = next(each, None)
    several = found[0]
    for f in found[1:]:
        several = several.unionByName(f)
    several = several.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("i"))

    def merge(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(_merged, batch.column(1).to_pylist())), _SPANS), batch.column(2)], ["row", "s", "i"])

    several = several.mapInArrow(merge, "row long, s array<struct<start:long,stop:long>>, i array<string>")
    rows = base.select(F.col("doc_id").alias("row"), "n_words").join(ids, "row").join(several, "row", "left")
    return rows.select("doc_id", "n_words", F.coalesce("s", F.from_json(F.lit("[]"), "array<struct<start:long,stop:long>>")).alias("spans"), F.coalesce("i", F.array().cast("array<string>")).alias("item_ids"))


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return found.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, block: int = BLOCK) -> DataFrame:
    """The documents of which no word lies in a benchmark window, all their columns as they are; each row is judged by
    itself where it is read, whether its id is null or repeated. Each block is a filter of what those before it left,
    written before the next."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def left_by(now: DataFrame, grams: Grams) -> DataFrame:
        held = now.sparkSession.sparkContext.broadcast(grams)

        def scan(batches):
            for batch in batches:
                for i, j in pieces(batch.column(at)):
                    part = batch.slice(i, j - i)
                    w = words(part.column(at), "plain", lower=True)
                    bad = np.zeros(j - i, bool)
                    bad[w.text_of()[_hit(w, held.value)[0]]] = True
                    yield part.filter(pa.array(~bad, pa.bool_()))

        return now.mapInArrow(scan, now.schema)

    now = docs
    for k, grams in enumerate(benchmark_blocks(benchmark, n, block)):
        now = left_by(saved(now, "clean") if k else now, grams)
    return now
