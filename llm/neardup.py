"""Near-duplicate documents: LSH forest over MinHash signatures, candidates confirmed on full shingle sets.

1. Each task computes for its documents the set of word shingles, a digest of the set and a MinHash signature.
   Documents with equal sets are one class, joined by a grouped aggregation; only classes go on.
2. Every tree of the forest orders the classes by the signature, read from another coordinate on. A region is a run of
   classes with a common prefix. Regions start at `depth` coordinates. A small one is compared in full: these are all its
   longest-common-prefix neighbours. A larger one is divided by deeper prefixes until its parts are small; at every depth
   each member is compared with the hub, the member that agrees with most of the others, and with its neighbours in
   sorted order. A region too large for one task is divided by deeper prefixes beforehand, and the hub of its largest
   part compared with all members.
3. Candidate pairs are confirmed on the full sets, made anew from the texts. The pairs of one document are dealt in
   chunks, so a hub with very many partners is no hot key.
4. Confirmed links are contracted to components by alternating large-star and small-star steps.
5. So far a larger region was not compared in full. Now each of its members outside its largest component is compared
   with all members of other components by sketches of one bit a coordinate, which are made for such regions only; pairs
   that agree about as often as linked documents do go through steps 3 and 4 again. So a link is missed only if no tree has both ends in one region (for a similarity of 0.85 fewer than
   one in 100,000, for 0.80, where the trees are the same, about 22 in 100,000) or their signatures agree less than is likely by more than four standard deviations.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.cluster import ROW, internal, join_hot, keyed, partitions, saved, ship, within, without
from llm.text import mix, pieces, windows, words

U = np.uint64
#: Coordinates of a signature, trees of the forest, coordinates of the shortest prefix that makes a region.
COORDINATES, TREES, DEPTH = 64, 16, 4
#: Coordinates that a tree can read: the deepest prefix.
DEEPEST = 16
#: Members of a region that are compared in full, and that one task compares.
SMALL, LARGE = 32, 2000
#: Bits of the sketches by which what is left over is compared.
BITS = 1024
#: Pairs confirmed in one chunk with the set of their common document.
CHUNK = 64

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | U(1)
_B = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, BITS, dtype=np.uint64) | U(1)


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The set of each text, as sorted hashes: its n-word shingles, or its only sequence if it has fewer words."""
    w = words(texts, "space", lower=True)
    h = w.hashes()
    got, at = windows(h, w.first, n)
    edge = np.searchsorted(at, w.first)
    out = []
    for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        if b > a:
            out.append(np.unique(got[a:b]))
        elif w.first[i + 1] > w.first[i]:
            own = h[w.first[i] : w.first[i + 1]]
            acc = U(len(own))
            for x in own:
                acc = mix(np.array([acc ^ x], U))[0]
            out.append(np.array([acc], U))
        else:
            out.append(np.zeros(0, U))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    out = np.empty(COORDINATES, U)
    for i in range(COORDINATES):
        x = s * _A[i] + _B[i]
        out[i] = (x ^ (x >> U(32))).min()
    return mix(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """One bit of each of many more coordinates, in 64-bit words."""
    least = np.empty(BITS, U)
    step = max(1, (1 << 18) // max(len(s), 1))
    for i in range(0, BITS, step):
        x = s[None, :] * _C[i : i + step, None]
        least[i : i + step] = (x ^ (x >> U(29))).min(axis=1)
    return np.packbits((mix(least) >> U(63)).astype(np.uint8)).view(U)


_META = "doc_id long, n_shingles long, digest binary, sig binary"


def described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature (two bytes a coordinate) of each document; nulls for an empty set."""

    def scan(batches):
        for batch in batches:
            for i, j in pieces(batch.column(1)):
                part = batch.slice(i, j - i)
                sets = shingles(part.column(1), n)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return docs.select("doc_id", "text").mapInArrow(scan, _META)


def orders(sig: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree the labels (coordinates that it reads, in its order) and regions (hashes of the shortest prefixes)."""
    out = []
    for t in range(TREES):
        label = sig[:, (np.arange(DEEPEST) + t * (COORDINATES // TREES)) % COORDINATES]
        region = np.full(len(sig), U(t + 1))
        for d in range(DEPTH):
            region = mix(region ^ label[:, d])
        out.append((label, region))
    return out


def forest(classes: DataFrame) -> DataFrame:
    """tree, region (hash of the shortest prefix), rep, n and label (the coordinates that the tree reads) of each class."""

    def grow(batches):
        for batch in batches:
            m = len(batch)
            if not m:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), U).reshape(m, COORDINATES)
            for label, region in orders(sig):
                brief = np.ascontiguousarray((label >> U(48)).astype(">u2"))
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), batch.column(0), batch.column(1), pa.array([r.tobytes() for r in brief], pa.binary())], ["region", "rep", "n", "label"])

    return classes.select("rep", "n", "sig").mapInArrow(grow, "region long, rep long, n long, label binary")


def _hub(label: np.ndarray, rep: np.ndarray) -> int:
    """The member whose coordinates agree with most others; the smallest of several."""
    agree = np.zeros(len(rep), np.int64)
    for c in range(label.shape[1]):
        _, which, times = np.unique(label[:, c], return_inverse=True, return_counts=True)
        agree += times[which]
    return int(np.lexsort((rep, -agree))[0])


def _pairs_of(label: np.ndarray, rep: np.ndarray, n: np.ndarray, ratio: float, small: int) -> list[tuple[int, int]]:
    """Candidates (hub, other) within one region, as indexes. label: a row for each member."""
    out: list[tuple[int, int]] = []

    def may(a, b):
        return np.minimum(n[a], n[b]) >= ratio * np.maximum(n[a], n[b])

    stack = [(np.lexsort((rep, *label.T[::-1])), DEPTH)]
    while stack:
        idx, depth = stack.pop()
        if len(idx) <= small:
            for k in range(len(idx) - 1):
                rest = idx[k + 1 :]
                out.extend((int(idx[k]), int(x)) for x in rest[may(idx[k], rest)])
            continue
        hub = idx[_hub(label[idx], rep[idx])]
        rest = idx[idx != hub]
        out.extend((int(hub), int(x)) for x in rest[may(hub, rest)])
        ok = may(idx[:-1], idx[1:])
        out.extend((int(a), int(b)) for a, b in zip(idx[:-1][ok], idx[1:][ok], strict=True))
        if depth < label.shape[1]:
            cut = np.flatnonzero(np.any(label[idx[1:], : depth + 1] != label[idx[:-1], : depth + 1], axis=1)) + 1
            stack.extend((part, depth + 1) for part in np.split(idx, cut) if len(part) > 1)
    return out


def _labels(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(len(column), -1)


def _by_key(found, columns: tuple[str, ...], schema: str, names: list[str]):
    """For mapInArrow over rows sorted by the first columns: call found with the table of each key, batch or not."""
    types = [pa.int64()] * len(names)

    def scan(batches):
        held: list[pa.RecordBatch] = []

        def flush(done):
            t = pa.Table.from_batches(done)
            keys = [t.column(c).to_numpy() for c in columns]
            new = np.zeros(len(t), bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            edge = np.append(np.flatnonzero(new), len(t))
            rows: set[tuple] = set()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                rows.update(found(t.slice(a, b - a)))
            cols = zip(*sorted(rows), strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names)

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            last = np.ones(len(batch), bool)
            for c in columns:
                k = batch.column(batch.schema.get_field_index(c)).to_numpy()
                last &= k == k[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield flush([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
        if held:
            yield flush(held)

    return scan, schema


def parted(trees: DataFrame, regions: DataFrame, large: int) -> DataFrame:
    """region, part, wide, rep, n, label: the members of all regions (region, count) in parts of at most about so many.

    A wide region is divided by deeper prefixes: each member goes to the shortest one that few enough share. Members that
    too many share the deepest prefix with are dealt by their hash.
    """
    narrow = trees.join(regions.where(F.col("count") <= large).select("region"), "region").select("region", F.lit(0).cast("long").alias("part"), F.lit(False).alias("wide"), "rep", "n", "label")
    wide = saved(regions.where(F.col("count") > large).select("region"), "wide")
    if wide.isEmpty():
        return narrow
    deep = saved(trees.join(wide, "region"), "wide-members").select("region", "rep", "n", "label", F.explode(F.array(*map(F.lit, range(DEPTH + 1, DEEPEST + 1)))).alias("depth"))
    deep = deep.withColumn("part", F.xxhash64("region", "depth", F.expr("substring(label, 1, 2 * depth)")))
    crowded = saved(deep.groupBy("part").count().where(F.col("count") > large), "crowded")
    here = F.struct("depth", "part", "count")
    own = deep.join(crowded, "part", "left").groupBy("region", "rep").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.min(F.when(F.col("count").isNull(), here)).alias("first"), F.max(here).alias("last"))
    dealt = F.xxhash64("last.part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("last.count") / large)))
    return narrow.unionByName(own.select("region", F.coalesce("first.part", dealt).alias("part"), F.lit(True).alias("wide"), "rep", "n", "label"))


def candidates(trees: DataFrame, regions: DataFrame, ratio: float, small: int, large: int) -> DataFrame:
    """Distinct pairs hub, other of class representatives from all regions (region, count) of all trees."""
    parts = partitions(trees.sparkSession)

    def pairs(t: pa.Table):
        rep, n, label = t.column("rep").to_numpy(), t.column("n").to_numpy(), _labels(t.column("label"))
        got = {(int(rep[x]), int(rep[y]), 0) for x, y in _pairs_of(label, rep, n, ratio, small)} if len(t) > 1 else set()
        if t.column("wide")[0].as_py():  # the hub of a part, with its region
            got.add((t.column("region")[0].as_py(), int(rep[_hub(label, rep)]), len(t)))
        return got

    scan, schema = _by_key(pairs, ("region", "part"), "hub long, other long, members long", ["hub", "other", "members"])
    rows = parted(trees, regions, large).repartition(parts, "region", "part").sortWithinPartitions("region", "part").select("region", "part", "wide", "rep", "n", "label")
    found = saved(rows.mapInArrow(scan, schema), "candidates")
    plain = found.where("members = 0").select("hub", "other")
    # in a region of several parts, the hub of its largest part is compared with all members
    top = saved(found.where("members > 0").groupBy(F.col("hub").alias("region")).agg(F.max(F.struct("members", "other")).alias("m")).select("region", F.col("m.other").alias("hub")), "top")
    if top.isEmpty():
        return once(plain)
    stars = trees.select("region", "rep").join(top, "region").where("rep != hub").select("hub", F.col("rep").alias("other"))
    return once(plain.unionByName(stars))


def once(pairs: DataFrame) -> DataFrame:
    """Each pair in one direction."""
    both = pairs.select("hub", "other", F.least("hub", "other").alias("lo"), F.greatest("hub", "other").alias("hi"))
    return both.groupBy("lo", "hi").agg(F.min("hub").alias("hub")).select("hub", (F.col("lo") + F.col("hi") - F.col("hub")).alias("other"))


def left_over(trees: DataFrame, regions: DataFrame, label: DataFrame, texts_of, n: int, ratio: float, large: int) -> DataFrame:
    """Pairs of members of one of these regions that are in different components, and whose sketches agree enough.

    Every such pair has an end outside the region's largest component; these few are sent to all chunks of the region.
    texts_of gives rep and text of the classes in a table with one column, rep.
    """
    parts = partitions(trees.sparkSession)
    agree = (1 + ratio) / 2
    least = int(np.floor(BITS * (agree - 4 * np.sqrt(agree * (1 - agree) / BITS))))
    rows = trees.select("region", "rep", "n").join(regions.select("region", F.ceil(F.col("count") / large).cast("int").alias("chunks")), "region")
    rows = rows.join(label, rows["rep"] == label["node"], "left").drop("node").withColumn("component", F.coalesce("component", "rep"))
    by = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("k"))
    main = by.groupBy("region").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("several")).where("several > 1").select("region", F.col("m.component").alias("main"))
    rows = saved(rows.join(main, "region"), "left-over-rows")

    def scan_texts(batches):
        for batch in batches:
            for i, j in pieces(batch.column(1)):
                part = batch.slice(i, j - i)
                sets = [s if len(s) else np.zeros(1, U) for s in shingles(part.column(1), n)]
                places = np.stack([r for _, r in orders(np.stack([signature(s) for s in sets]))], axis=1)
                data = [sketch(s).tobytes() + p.tobytes() for s, p in zip(sets, places, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["rep", "sketch"])

    sketches = texts_of(rows.select("rep").distinct()).dropDuplicates(["rep"]).select("rep", "text").mapInArrow(scan_texts, "rep long, sketch binary")
    rows = rows.join(saved(sketches, "sketches"), "rep")
    members = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("probe", F.lit(False))
    probes = rows.where("component != main").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("probe", F.lit(True))
    both = members.unionByName(probes).repartition(parts, "region", "chunk").sortWithinPartitions("region", "chunk").select("region", "chunk", "probe", "rep", "n", "component", "sketch")

    def cross(t: pa.Table):
        probe = np.asarray(t.column("probe"))
        rep, size, comp = t.column("rep").to_numpy(), t.column("n").to_numpy(), t.column("component").to_numpy()
        data = np.frombuffer(b"".join(t.column("sketch").to_pylist()), U).reshape(len(t), -1)
        bits, places = data[:, : BITS // 64], data[:, BITS // 64 :]
        here = np.array(t.column("region")[0].as_py(), np.int64).view(U)
        out, member = set(), ~probe
        for i in np.flatnonzero(probe):
            ok = np.flatnonzero(member & (comp != comp[i]) & (np.minimum(size, size[i]) >= ratio * np.maximum(size, size[i])))
            near = BITS - np.bitwise_count(bits[ok] ^ bits[i]).sum(axis=1, dtype=np.int64) >= least
            ok = ok[near]
            # a pair that several regions hold is given by the first of them
            first = places[i][(places[ok] == places[i]).argmax(axis=1)] == here
            out.update((int(rep[i]), int(x)) for x in rep[ok[first]])
        return out

    scan, schema = _by_key(cross, ("region", "chunk"), "hub long, other long", ["hub", "other"])
    return once(both.mapInArrow(scan, schema))


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union. docs: rep and text of all classes in pairs."""
    parts = partitions(pairs.sparkSession)
    stars = saved(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("partners"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "stars")
    # a hub with very many partners is broadcast, so that its pairs stay where they are until they are dealt into chunks
    dealt = join_hot(pairs, stars, "hub", "partners", pairs.count()).select("hub", "other", F.pmod(F.xxhash64("other"), F.col("chunks")).cast("int").alias("chunk"))
    hubs = stars.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("other"), F.col("hub").alias("rep"))
    rows = hubs.unionByName(dealt.withColumn("rep", F.col("other"))).join(docs, "rep").select("hub", "chunk", "other", "text")

    def scan(batches):
        now, own = None, None
        for batch in batches:
            hub, chunk, other = (batch.column(i).to_pylist() for i in range(3))
            links = []
            for i, j in pieces(batch.column(3)):
                for k, s in zip(range(i, j), shingles(batch.column(3).slice(i, j - i), n), strict=True):
                    if other[k] is None:  # sorted first in its chunk
                        now, own = (hub[k], chunk[k]), s
                    elif now == (hub[k], chunk[k]):
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(s) - both):
                            links.append((hub[k], other[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["hub", "other"])

    return rows.repartition(parts, "hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("other").asc_nulls_first()).mapInArrow(scan, "hub long, other long")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of all nodes in links (columns hub, other)."""
    digest = lambda t: t.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = saved(links.select(F.greatest("hub", "other").alias("u"), F.least("hub", "other").alias("v")).where("u != v").distinct(), "links")
    now = digest(edges)
    while True:
        # large star: the larger neighbours of each node are tied to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, before = saved(small, "links"), now
        now = digest(edges)
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", small: int = SMALL, large: int = LARGE) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest id reachable over links), kept.

    Two documents are linked if their sets of n-word shingles have a Jaccard similarity of percent / 100 or more; a text
    of fewer words is one shingle, a null or empty one has none and is linked with nothing. Rows with a null id get a
    null component and are kept; rows repeated with the same id are one document. Other columns are left aside. An empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    own = internal(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    meta = saved(described(own, n), "meta")
    total = meta.count()
    classes = saved(
        meta.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("size")), "classes"
    )
    ratio = percent / 100
    trees = forest(classes)
    regions = saved(trees.groupBy("region").count().where("count > 1"), "regions")

    def texts_of(reps: DataFrame) -> DataFrame:
        return within(own.withColumnRenamed("doc_id", "rep"), saved(reps, "ids"), "rep")

    def links(pairs: DataFrame) -> DataFrame:
        reps = pairs.select(F.col("hub").alias("rep")).unionByName(pairs.select(F.col("other").alias("rep"))).distinct()
        return saved(confirmed(pairs, texts_of(reps), n, percent), "confirmed")

    pairs = saved(candidates(trees, regions, ratio, small, large), "pairs")
    found = links(pairs)
    label = saved(components(found), "components")
    wide = saved(regions.where(F.col("count") > small), "wide")
    if not wide.isEmpty():
        tried = pairs.select(F.least("hub", "other").alias("lo"), F.greatest("hub", "other").alias("hi"))
        more = left_over(trees, wide, label, texts_of, n, ratio, large).select("hub", "other", F.least("hub", "other").alias("lo"), F.greatest("hub", "other").alias("hi"))
        more = saved(more.join(tried, ["lo", "hi"], "left_anti").select("hub", "other"), "left-over")
        if not more.isEmpty():
            again = links(more)
            if not again.isEmpty():
                label = components(label.select(F.col("node").alias("hub"), F.col("component").alias("other")).unionByName(again))
    named = classes.join(label, classes["rep"] == label["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"), "size")
    named = saved(named, "named")
    known = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    slim = meta.select("doc_id", "n_shingles", "digest")
    linked = join_hot(slim.where(known), named, "digest", "size", total).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = slim.where(~known).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that near_duplicates() keeps, all their columns as they are. Each row is a document of its own; those
    whose id is null or repeated come after all others."""
    docs = keyed(docs)
    drop = near_duplicates(docs, n=n, percent=percent, doc_id=ROW).where("not kept").select(F.col("doc_id").alias(ROW))
    return without(docs, saved(drop, "drop"), ROW).drop(ROW)
