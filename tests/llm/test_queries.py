"""The registered queries that have no SQL, on a small folder of tables, against brute force."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from llm import language, licenses, queries
from tests.llm.conftest import ODD
from tests.llm.test_models import SAMPLES, WORD, base, brute_language, brute_targets, brute_windows, secret_texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    notices = [v for vs in licenses.TEMPLATES.values() for v in vs]
    texts = [*ODD[:-1], *secret_texts(60, 1), *(f"{SAMPLES[x]} {rng.choice(notices)}" for x in SAMPLES for _ in range(8)), *notices[:20]]
    rows = [(i * 7, t, rng.choice([*SAMPLES, None]), rng.choice(["a", "b", None]), 0) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    pages = [(i, f"http://h{i % 3}.{x}.net/{x}/1" if i % 5 else None, f'<html lang="{x}"><p>{SAMPLES[x]}</p>' if i % 7 else None) for i, x in enumerate([*SAMPLES] * 6)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    return str(path), rows, pages


def test_secret_scan(spark, folder):
    path, rows, _ = folder
    got = {r.doc_id: r for r in queries.op4_secret_scan(spark, path).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        own = base(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        n = Counter(k for k, _, _ in own)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == (n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest())
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("crf")] == [x for x in said.split(",") if x]


def test_license_scan(spark, folder):
    path, rows, _ = folder
    got = {r.doc_id: r for r in queries.op5_license_scan(spark, path).collect()}
    seen = [set(licenses.terms(r[1] or "")) for r in rows]
    counts = {t: sum(t in w for w in seen) for t in licenses.Vocabulary(licenses.TEMPLATES).terms}
    judge = licenses.Judge(licenses.TEMPLATES, len(rows), counts)
    share = [s for _, _, s in judge.judged(pa.array([r[1] for r in rows], pa.large_string()))]
    own, given = {}, {}
    folder_of = lambda i, s: f"{s or 'none'}/{i // 1000}/{i // 100}"
    for (i, t, _, s, _), part in zip(rows, share, strict=True):
        best = brute_windows(t, judge, len(rows), counts)
        free = {k: c for k, c in best.items() if k != licenses.RESERVED} or best
        own[i] = max(((round(c, 9), k) for k, c in free.items()), default=(0.0, None))
        if own[i][1] and (i % 100 == 0 or part >= 0.5):
            given[folder_of(i, s)] = max(given.get(folder_of(i, s), (0.0, "")), own[i])
    assert given
    for i, _, _, s, _ in rows:
        d = folder_of(i, s)
        assert got[i].path == f"{d}/{'LICENSE' if i % 100 == 0 else f'{i}.txt'}" and got[i].license == own[i][1]
        assert got[i].inherited == (None if own[i][1] else given.get(d, (0, None))[1])


def test_mixture(spark, folder):
    path, rows, _ = folder
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    by: Counter = Counter()
    for i, _, _, s, _ in rows:
        by[s] += sizes[i]
    want, taken = brute_targets(by), Counter()
    got = {r.doc_id: r for r in queries.op7_mixture(spark, path).collect()}
    for i, _, _, s, _ in rows:
        assert (got[i]["size"], got[i].source_size) == (sizes[i], by[s]) and got[i].target == pytest.approx(want[s])
        assert got[i].taken in {k * sizes[i] for k in range(4)}
        taken[s] += got[i].taken
    assert all(abs(taken[s] - t) <= max(sizes.values()) for s, t in want.items())


def test_language_id(spark, folder):
    path, rows, pages = folder
    fields = []
    for i, url, html in pages:
        host = re.match(r"http://([^/]*)", url)[1] if url else ""
        tld = host.rpartition(".")[2]
        suffix = language.SUFFIX.get(tld, "") if len(tld) == 2 else re.search(r"\.net/(..)/", url)[1] if url else ""
        text = re.sub(r"<[^>]*>", " ", html or "")
        declared = re.search(r'lang="(..)"', html)[1] if html else ""
        fields.append((i, text, declared, suffix, host, ".".join(host.split(".")[-2:])))
    want = {r[0]: (r[1], r[2]) for r in brute_language(fields, [(t, x) for _, t, x, _, _ in rows])}
    got = {r.page_id: (r.text_lang, r.lang) for r in queries.op9_language_id(spark, path).collect()}
    assert got == want
