"""Removal of word windows that documents share, found by level-wise doubling.

Documents are dealt once into groups by a hash of their id. At the first level each group sends the owners of hash ranges
the Golomb-coded fingerprints of its windows of `start` words; owners answer with bitmaps of those that came more than
once. Only where two such windows together span twice the length can the longer one repeat, so only these are sent at
the next level, until the target length is reached or no candidates survive. At the target length a group sends two
64-bit hashes of each window, made of different hashes of its words, with the smallest id it holds for it; the answer is
whether that is the smallest of all. With N windows some N ** 2 / 2 ** 129 pairs of different ones are taken for equal.

The shuffle of the documents is the same at each level, so Spark makes it once and reuses it.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.cluster import internal, partitions, ship
from llm.exact import golomb, ungolomb
from llm.text import covered, windows, words

#: Bits of the fingerprints of shorter windows: wrong candidates among them only cost work.
BITS = 44
#: Groups of documents for each shuffle partition, and shuffle partitions for each owner: lists are as many as groups times owners.
GROUPS, OWNED = 2, 2

_REPLY = "g long, level int, owner int, bitmap binary"
_LIST = "g long, level int, owner int, list binary, second binary, twice binary, least binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def levels(start: int, n: int) -> list[int]:
    out = [min(start, n)]
    while out[-1] < n:
        out.append(min(2 * out[-1], n))
    return out


class Group:
    """The windows of some documents that are still candidates, level by level."""

    def __init__(self, table: pa.Table, sizes: list[int], owners: int):
        self.table, self.sizes, self.owners = table, sizes, owners
        self.words = words(table.column("text"))
        self.hash = self.words.hashes()
        ids = table.column("doc_id").to_numpy(zero_copy_only=False)
        known = ~np.asarray(table.column("doc_id").is_null())
        self.ids = np.where(known, np.nan_to_num(ids), 0).astype(np.int64) if not known.all() else ids.astype(np.int64)
        self.known = np.repeat(known, np.diff(self.words.first))
        self.good: np.ndarray | None = None  # by word: a window of the last size that starts here is a candidate

    def distinct(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First words of the candidates of a level, their distinct fingerprints (first and second hash; the second at the
        last level only, elsewhere empty), which each has, and how many have it."""
        h, at = self.at_level(k)
        if k < len(self.sizes) - 1:
            v, which, n = np.unique(h >> np.uint64(64 - BITS), return_inverse=True, return_counts=True)
            return at, v, v[:0], which, n
        second, every = windows(self.words.hashes(1), self.words.first, self.sizes[k])
        second = second[np.searchsorted(every, at)]
        order, new = _by_pair(h, second)
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        return at, h[order][new], second[order][new], which, np.bincount(which, minlength=int(new.sum()))

    def at_level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first words of the candidates of this level."""
        size = self.sizes[k]
        h, at = windows(self.hash, self.words.first, size)
        ok = self.known[at]
        if k:
            ok &= self.good[at] & self.good[at + size - self.sizes[k - 1]]
        return h[ok], at[ok]

    def take(self, k: int, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Candidates of a level, their distinct fingerprints, for each candidate which, and what the owners said of each."""
        at, v, _, which, _ = self.distinct(k)
        said = np.zeros(len(v), bool)
        for o, a, b in self.cuts(v, k):
            if o in replies:
                said[a:b] = np.unpackbits(np.frombuffer(replies[o], np.uint8), count=b - a)
        self.good = np.zeros(len(self.hash) + 1, bool)
        self.good[at[said[which]]] = True
        return at, v, which, said

    def cuts(self, v: np.ndarray, k: int):
        bits = 64 if k == len(self.sizes) - 1 else BITS
        owner = ((v >> np.uint64(bits - 32)) * np.uint64(self.owners)) >> np.uint64(32)
        edge = np.searchsorted(owner, np.arange(self.owners + 1, dtype=np.uint64))
        return [(o, int(a), int(b)) for o, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]

    def lists(self, k: int, g: int) -> pa.Table:
        at, v, second, which, n = self.distinct(k)
        last = k == len(self.sizes) - 1
        least = np.full(len(v), np.iinfo(np.int64).max)
        if last:
            np.minimum.at(least, which, self.ids[self.words.text_of()[at]])
        rows = [(g, k, o, golomb(v[a:b], 64 if last else BITS), _planes(second[a:b]) if last else b"", np.packbits(n[a:b] > 1).tobytes(), _planes(least[a:b]) if last else b"") for o, a, b in self.cuts(v, k)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        cols = zip(*rows, strict=True) if rows else [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["g", "level", "owner", "list", "second", "twice", "least"])


def _by_pair(v: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs, and where a new one begins."""
    order = np.lexsort((second, v))
    new = np.ones(len(v), bool)
    new[1:] = (v[order][1:] != v[order][:-1]) | (second[order][1:] != second[order][:-1])
    return order, new


def _planes(x: np.ndarray) -> bytes:
    """Bytes of one weight together, which compresses."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _answer(key, table):
    """Of one owner and level: for each list, which fingerprints are repeated, or at the last level whose id is the least."""
    lists = [ungolomb(x.as_py()) for x in table.column("list")]
    v = np.concatenate(lists)
    last = bool(table.column("least")[0].as_py())
    second = np.concatenate([_unplanes(x.as_py()) for x in table.column("second")]) if last else np.zeros(len(v), np.int64)
    order, new = _by_pair(v, second)
    which = np.empty(len(v), np.int64)
    which[order] = np.cumsum(new) - 1
    if last:
        least = np.concatenate([_unplanes(x.as_py()) for x in table.column("least")])
        starts = np.flatnonzero(new)
        said = least == np.minimum.reduceat(least[order], starts)[which]
    else:
        twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(y)) for x, y in zip(table.column("twice"), lists, strict=True)])
        said = np.bincount(which, weights=1.0 + twice)[which] > 1
    edge = np.cumsum([0, *map(len, lists)])
    maps = [np.packbits(said[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"g": table.column("g"), "level": table.column("level"), "owner": table.column("owner"), "bitmap": pa.array(maps, pa.binary())})


def _replies(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for k, o, b in zip(table.column("level").to_pylist(), table.column("owner").to_pylist(), table.column("bitmap").to_pylist(), strict=True):
        out.setdefault(k, {})[o] = b
    return out


def remove_repeats(docs: DataFrame, *, n: int = 13, start: int = 7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, n_words, spans of removed words (stop exclusive), text of the kept words.

    A word goes if a window of n words that covers it also starts in a document with a smaller id. Windows are those of
    the input, not of what is left. Null texts count as empty; a text with fewer words than a window keeps all; rows with
    a null id are kept whole and take nothing from others; rows with equal ids take nothing from each other. Other
    columns are left aside. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    owners, groups, sizes = max(1, partitions(spark) // OWNED), GROUPS * partitions(spark), levels(start, n)
    dealt = internal(docs, doc_id=doc_id, text=text).select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"), F.col("doc_id").cast("long"), "text")

    def send(k):
        def first(key, table):
            return Group(table, sizes, owners).lists(k, key[0].as_py())

        def later(key, table, said):
            group, replies = Group(table, sizes, owners), _replies(said)
            for i in range(k):
                group.take(i, replies.get(i, {}))
            return group.lists(k, key[0].as_py())

        return later if k else first

    said: DataFrame | None = None
    for k in range(len(sizes)):
        lists = dealt.groupBy("g").cogroup(said.groupBy("g")).applyInArrow(send(k), _LIST) if said is not None else dealt.groupBy("g").applyInArrow(send(k), _LIST)
        answers = lists.groupBy("owner").applyInArrow(_answer, _REPLY)
        said = answers if said is None else said.unionByName(answers)

    def finish(key, table, told):
        group, replies = Group(table, sizes, owners), _replies(told)
        for k in range(len(sizes)):
            at, v, which, own = group.take(k, replies.get(k, {}))
        ids = group.ids[group.words.text_of()]
        least = np.full(len(v), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[at])
        gone = covered(at[~own[which] | (ids[at] > least[which])], n, len(group.hash))
        first, kept, spans = group.words.first, [], []
        for i, t in enumerate(table.column("text")):
            out = gone[first[i] : first[i + 1]]
            own_words = (t.as_py() or "").encode().split()
            edge = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0])))) if out.any() else []
            spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(b" ".join(compress(own_words, ~out) if len(edge) else own_words).decode())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(first), pa.int64()), "spans": pa.array(spans, _SPAN), "text": pa.array(kept, pa.string())})

    return dealt.groupBy("g").cogroup(said.groupBy("g")).applyInArrow(finish, "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, text string")


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return found.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
