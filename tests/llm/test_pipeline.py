"""The pipeline's stages against brute force, each on its own input, and what each must not do."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from llm import language, mixture
from tests.llm.conftest import ODD
from tests.llm.test_dedup import near
from tests.llm.test_models import SAMPLES, brute_language


def test_stages_are_in_order():
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "MinHash", "benchmark", "mixing"]


def test_planted_cases(spark, docs, tmp_path):
    clean = [" ".join(f"{w}{i}" if k % 7 == 0 else w for k, w in enumerate((SAMPLES[x] * 3).split())) for i, x in enumerate(["en", "de", "fr"] * 6)]
    item = "this passage of the test set has more than ten words in it and should never be seen"
    copy = clean[0]
    near = " ".join("changed" if k == 30 else w for k, w in enumerate(clean[1].split()))
    leak = clean[2] + " " + item + " " + clean[5]
    texts = [*clean, copy, near, leak, *ODD[:3], "123 456"]
    n = len(clean)
    df = docs(texts, lang=["en", "de", "fr"] * 6 + ["en", "de", "fr"] + [None] * 4, source=["s1", "s2", "s3"] * 6 + ["s1"] * 7)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, kept = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns, name
        kept.append({r.doc_id for r in at.collect()})
    assert kept[0] == set(range(n + 3))
    assert kept[1] == kept[0] - {0}  # of the copies the largest id stays
    assert kept[2] == kept[1] - {n + 1}
    assert kept[3] == kept[2] - {n + 2}
    mixed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    rows = mixed.collect()
    assert mixed.columns == [*df.columns, "copy"]
    assert {r.doc_id for r in rows} <= kept[3] and max(r.copy for r in rows) <= 3
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)


def test_null_and_repeated_ids(spark, docs, tmp_path):
    item = "this passage of the test set has more than ten words in it and should never be seen"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    a, b, c, d = (" ".join(f"{w}{i}" if k % 7 == 0 else w for k, w in enumerate((SAMPLES[x] * 3).split())) for i, x in enumerate(["en", "de", "fr", "en"]))
    near = " ".join("changed" if k == 30 else w for k, w in enumerate(b.split()))

    def kept(k, rows):
        df = docs([t for _, t in rows], [i for i, _ in rows])
        out = corpus_pipeline.STAGES[k][1](spark, df, str(tmp_path))
        assert out.columns == [*df.columns, "copy"][: len(out.columns)]
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    order = lambda rows: sorted(rows, key=repr)
    assert kept(0, [(None, "123 456"), (None, a), (5, ""), (5, b), (5, b), (6, "")]) == order([(None, a), (5, b), (5, b)])
    assert kept(1, [(None, a), (None, a), (None, b), (1, b), (5, c), (5, c), (4, c), (7, d), (7, a), (8, None), (8, "")])[:] in (order([(1, b), (5, c), (7, d), (7, a), (8, x)]) for x in (None, ""))
    assert kept(2, [(None, b), (None, near), (2, a), (2, a), (3, c), (3, d)]) in (order([(None, x), (2, a), (3, c), (3, d)]) for x in (b, near))
    assert kept(3, [(None, item), (None, a), (5, b + " " + item), (5, c), (6, d)]) == order([(None, a), (5, c), (6, d)])
    # what the mixture gives to each row, not what it gives to any row of the id
    rows = [(None, a)] * 3 + [(4, "one"), (4, b), (4, b), *[(i, c) for i in range(10, 20)]]
    df = docs([t for _, t in rows], [i for i, _ in rows], source=["s", "t"] * 8)
    want = mixture.mix(df.withColumn("doc_id", F.monotonically_increasing_id())).agg(F.sum("copies")).first()[0]
    assert corpus_pipeline.STAGES[4][1](spark, df, str(tmp_path)).count() == want


def test_run_against_brute_force(spark, docs, tmp_path):
    """Every stage by plain Python on what the stage before it kept, from random texts with copies, near copies and leaks."""
    rng = random.Random(11)
    items = [(i, " ".join(f"q{rng.randrange(40)}" for _ in range(rng.choice([4, 10, 14])))) for i in range(4)]
    rows = []
    for i in range(70):
        lang = rng.choice(["en", "de", "fr"])
        text = " ".join(f"{w}{rng.randrange(40)}" if rng.random() < 0.3 else w for w in (SAMPLES[lang] * 2).split())
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.4:
            ws = (rng.choice(rows)[1] or "x").split()
            text = " ".join("other" if rng.random() < rng.choice([0.01, 0.1]) else w for w in ws)
        elif kind < 0.5:
            text = f"{text} {rng.choice(items)[1].upper()}, {text[:50]}"
        elif kind < 0.6:
            text = rng.choice([None, "", "12 34", "zqx kjw vvq xxq"])
        rows.append((i * 3 % 71, text, rng.choice([lang, lang, None]), rng.choice(["a", "b", None])))
    df = docs([r[1] for r in rows], [r[0] for r in rows], lang=[r[2] for r in rows], source=[r[3] for r in rows])
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    said = {r[0]: r[2] for r in brute_language([(i, t, None, None, s or "", "") for i, t, _, s in rows], [(t, x) for _, t, x, _ in rows])}
    kept = [r for r in rows if said[r[0]] != language.UND]
    assert 0 < len(kept) < len(rows)
    last = {}
    for r in kept:
        last[r[1] or ""] = max(last.get(r[1] or "", -1), r[0])
    kept = [r for r in kept if last[r[1] or ""] == r[0]]
    first = {i: k for i, _, _, k in near([r[1] for r in kept], [r[0] for r in kept], 5, 80)}
    kept = [r for r in kept if first[r[0]]]
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {tuple(w[i : i + min(10, len(w))]) for _, t in items for w in [plain(t)] for i in range(max(1, len(w) - 9)) if w}
    leaks = lambda t: any(tuple(w[i : i + n]) in grams for w in [plain(t)] for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    clean = [r for r in kept if not leaks(r[1])]
    assert 0 < len(clean) < len(kept)

    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got.keys() <= {r[0] for r in clean}
    # the mixture: its targets by filling up, its copies near them, none more than three times
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in clean}
    own = {s: sum(size[r[0]] for r in clean if r[3] == s) for s in {r[3] for r in clean}}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(own, key=lambda s: (s is None, s or "")))}
    want, left, live = {}, float(sum(own.values())), set(own)
    while live:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        full = {s for s in live if share[s] > 3 * own[s]}
        if not full:
            want |= share
            break
        want |= {s: 3.0 * own[s] for s in full}
        left -= sum(3.0 * own[s] for s in full)
        live -= full
    assert max(got.values()) <= 3
    for s in own:
        taken = sum(got.get(r[0], 0) * size[r[0]] for r in clean if r[3] == s)
        assert abs(taken - want[s]) <= max(size.values()), s


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 50 and "copy" in rows.columns


def test_run_of_nothing(spark, docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
