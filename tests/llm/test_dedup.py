"""Exact and near copies, shared passages, benchmark passages: against brute force and SQL on small tables."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from llm import decontaminate, exact, neardup, queries, substring
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def sql(name, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.execute(queries.ORACLE_SQL[name]).df()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), sql(name, sf)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).map(lambda v: round(float(v), 6) if isinstance(v, float) else v).values.tolist()))
    assert rows(got) == rows(want)


def made(seed=3, n=60):
    """Documents with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(rng.choice(out))
        elif kind < 0.5 and out:
            ws = rng.choice(out).split()
            for _ in range(rng.randrange(1, 4)):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            out.append(" ".join(ws))
        else:
            ws = rng.choices(vocabulary, k=rng.randrange(20, 150))
            if kind > 0.8:
                ws[5:5] = passage.split()
            out.append(" ".join(ws))
    return out


def copies(texts, ids):
    best, size = {}, {}
    for i, t in zip(ids, texts, strict=True):
        t = t or ""
        best[t] = i if t not in best or best[t] is None else best[t] if i is None else max(best[t], i)
        size[t] = size.get(t, 0) + 1
    return sorted(((i, best[t or ""], size[t or ""], i == best[t or ""], sha(t or "")) for i, t in zip(ids, texts, strict=True)), key=repr)


@pytest.mark.parametrize("bits", [48, 6])
def test_exact_copies(docs, bits):
    texts = [*ODD, *made(), "", None, *ODD[3:6]]
    ids = [*range(len(texts) - 1), None]
    got = exact.copies(docs(texts, ids), bits=bits)
    assert sorted(map(tuple, got.collect()), key=repr) == copies(texts, ids)


def test_exact_copies_of_repeated_rows_and_of_nothing(docs):
    got = exact.copies(docs(["a", "a", "b"], [1, 1, 2])).collect()
    assert sorted(map(tuple, got)) == sorted([(1, 1, 2, True, sha("a")), (1, 1, 2, True, sha("a")), (2, 2, 1, True, sha("b"))])
    assert exact.copies(docs([])).collect() == []
    assert [r.doc_id for r in exact.distinct_documents(docs(["a", "a", "b"])).orderBy("doc_id").collect()] == [1, 2]


def near(texts, ids, n, percent):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        ws = WORD.findall(lower(t))
        sets[i] = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()
    label = {i: i for i in ids}
    while True:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and label[a] != label[b] and sets[a] and sets[b]:
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
        if not changed:
            return sorted((i, len(sets[i]), label[i], label[i] == i) for i in ids)


@pytest.mark.parametrize("options", [{}, {"small": 2, "large": 4}])
def test_near_copies(docs, options):
    texts = [*ODD[:-1], *made(5), *ODD[3:6], "One", "two words", "Two words"]
    got = neardup.near_duplicates(docs(texts), percent=80, **options).collect()
    assert sorted(map(tuple, got)) == near(texts, range(len(texts)), 5, 80)


def test_near_copies_of_one_large_group(docs):
    """Copies that differ from a base in a few words each, so that many are linked through it only."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(120):
        ws = list(base)
        for _ in range(2):
            ws[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(ws))
    got = neardup.near_duplicates(docs(texts), percent=85, small=8, large=30).collect()
    assert sorted(map(tuple, got)) == near(texts, range(len(texts)), 5, 85)


def test_near_copies_without_ids_or_rows(docs):
    got = neardup.near_duplicates(docs(["a b c d e f", "a b c d e f", None], [None, 4, None])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, None, True), (4, 2, 4, True), (None, 0, None, True)], key=repr)
    assert neardup.near_duplicates(docs([])).collect() == []
    assert [r.doc_id for r in neardup.one_of_each(docs(["a b c d e f g", "a b c d e f g", "other"])).orderBy("doc_id").collect()] == [0, 2]


def kept(texts, ids, n):
    first = {}
    for i, t in zip(ids, texts, strict=True):
        ws = WORD.findall(t or "")
        for k in range(len(ws) - n + 1 if i is not None else 0):
            key = tuple(ws[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in zip(ids, texts, strict=True):
        ws = WORD.findall(t or "")
        gone = set()
        for k in range(len(ws) - n + 1 if i is not None else 0):
            if first[tuple(ws[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((i, len(ws), len(gone), sha(" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, start", [(13, 7), (13, 13), (5, 2), (16, 2), (1, 1)])
def test_shared_passages(docs, n, start):
    texts = [*ODD, *made(7), *ODD]
    ids = [*range(5, len(texts) + 3), 0, None]
    got = substring.summary(substring.remove_repeats(docs(texts, ids), n=n, start=start)).collect()
    assert sorted(map(tuple, got), key=repr) == kept(texts, ids, n)


def test_shared_passages_of_repeated_ids_and_of_nothing(docs):
    text = " ".join(f"w{i}" for i in range(20))
    got = substring.remove_repeats(docs([text, text], [3, 3])).collect()
    assert [(len(r.spans), r.text) for r in got] == [(0, text)] * 2
    assert substring.remove_repeats(docs([])).collect() == []
    assert substring.levels(7, 13) == [7, 13] and substring.levels(2, 16) == [2, 4, 8, 16] and substring.levels(20, 13) == [13]


def test_benchmark_passages(spark, docs):
    item = " ".join(f"i{k}" for k in range(14))
    items = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, "!!"), (None, "secret sauce here"), (1, "other one")], "item_id long, text string")
    texts = [f"before {item.upper()} after", "some Two, WORDS here two words", "secret sauce here", f"x {' '.join(item.split()[:9])} y", None, ""]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(texts), items, n=10, block=15).collect()}
    assert [(s.start, s.stop) for s in got[0].spans] == [(1, 15)] and got[0].item_ids == ["1"]
    assert [(s.start, s.stop) for s in got[1].spans] == [(1, 3), (4, 6)] and got[1].item_ids == ["2"]
    assert [(s.start, s.stop) for s in got[2].spans] == [(0, 3)] and got[2].item_ids == []
    assert not got[3].spans and not got[4].spans and got[4].n_words == 0
    clean = decontaminate.clean(docs(texts), items)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5] and clean.columns == docs(texts).columns
    none = decontaminate.decontaminate(docs(texts), items.limit(0))
    assert all(not r.spans for r in none.collect())
    assert decontaminate.decontaminate(docs([]), items).collect() == []


def test_equal_hashes_are_told_apart(monkeypatch, docs, spark):
    import numpy as np

    real = decontaminate.windows
    monkeypatch.setattr(decontaminate, "windows", lambda h, first, n: (np.zeros_like(real(h, first, n)[0]), real(h, first, n)[1]))
    g = decontaminate.Grams([(1, "a b"), (2, "c d")], 2)
    import pyarrow as pa

    w = decontaminate.words(pa.array(["x c d y"]), "plain")
    assert list(decontaminate.hits(w, w.hashes(), g)) == [(1, 2, [2])]


@pytest.mark.parametrize("most", [1 << 27, 1 << 15])
def test_rows_by_keys(spark, monkeypatch, most):
    from llm import cluster

    monkeypatch.setattr(cluster, "BLOOM_BITS", most)
    rows = spark.range(-3000, 9000).withColumnsRenamed({"id": "k"}).withColumns({"_place0": F.lit("clash"), "_Maybe": F.lit(1), "t": F.col("k").cast("string")})
    keys = cluster.saved(spark.range(0, 20000, 3).select(F.col("id").alias("k")))
    own = {x for x in range(0, 9000) if x % 3 == 0}
    got = cluster.within(rows, keys, "k")
    assert got.columns == rows.columns and sorted(r.k for r in got.collect()) == sorted(own)
    rest = cluster.without(rows, keys, "k")
    assert rest.columns == rows.columns and sorted(r.k for r in rest.collect()) == sorted(set(range(-3000, 9000)) - own)
    none = cluster.saved(keys.limit(0))
    assert cluster.within(rows, none, "k").count() == 0 and cluster.without(rows, none, "k").count() == 12000
    passed = cluster.sieved(rows, keys, "k")[0].count()
    assert passed >= len(own) and (most < 1 << 20 or passed < len(own) + 300)


def test_suspects_do_not_depend_on_the_partitions(docs):
    texts = [f"text {i % 40}" for i in range(60)] + [f"own {i}" for i in range(60)]
    df = docs(texts).repartition(5, "doc_id")
    files = exact.exchanged(df.select("text"))
    alone = exact.told_apart(df, files)[1].count()
    assert alone >= 60  # those of their own, and of the others none
    for other in (df.repartition(2, "n_chars"), df.coalesce(1), df.repartition(9, "doc_id")):
        rows = exact.told_apart(other, files)[1].select("text").collect()
        assert not {r.text for r in rows} & {f"text {i}" for i in range(20)}


def test_blocks_of_windows():
    items = [(i, "\n".join(f"w{i}x{k}" for k in range(200))) for i in range(20)] + [(99, "one"), (98, None)]
    got = list(decontaminate.blocks(items, 10, 1000))
    assert sum(map(len, got)) == 20 * 191 + 1 and max(map(len, got)) <= 1000 and len(got) == 4
    assert [len(g) for g in decontaminate.blocks(items[:2], 10, 5)] == [191, 191]


def test_passes_over_blocks_give_the_same(spark, docs):
    items = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 30}" for k in range(12))) for i in range(10)] + [(20, "a b"), (None, "b c")], "item_id long, text string")
    texts = [" ".join(f"w{(i + k) % 30}" for k in range(40)) + " a b c" for i in range(6)] + [None, "", "a b"]
    df = docs(texts, [None, 1, 1, *range(2, 8)])
    one, many = (sorted(map(tuple, decontaminate.summary(decontaminate.decontaminate(df, items, block=b)).collect()), key=repr) for b in (10**6, 3))
    assert one == many and any(r[2] for r in one)
    left = [sorted((r.text for r in decontaminate.clean(df, items, block=b).collect()), key=repr) for b in (10**6, 3)]
    assert left == [["", None]] * 2


def test_equal_first_hashes_of_windows(monkeypatch, docs):
    from llm.text import Words

    real = Words.hashes
    monkeypatch.setattr(Words, "hashes", lambda self, which=0: real(self, which) % 3 if which == 0 else real(self, which))
    texts = [" ".join(f"w{(i * 31 + k * 17) % 97}" for k in range(40)) for i in range(12)]
    texts += [texts[2], texts[5] + " x"]
    import numpy as np
    import pyarrow as pa

    g = substring.Group(pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)}), [5], 4)
    at, v, second, which, n = g.distinct(0)
    grams = [" ".join(t.split()[i : i + 5]) for t in texts for i in range(len(t.split()) - 4)]
    assert len(v) == len(set(grams)) and len(np.unique(v)) < len(v) and len(at) == len(grams)
