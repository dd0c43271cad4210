"""Operators with models: against brute force, exact round trips, and held-out accuracy."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import chat, language, licenses, lm, mixture, secrets
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# language model


def brute_lm(train, texts, order=2):
    told = lambda t: ["<s>"] * (order - 1) + [*WORD.findall(lower(t)), "</s>"]
    grams = lambda s: [tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s))]
    counts = {order: Counter(g for t in train for g in grams(told(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    uni = Counter(w for t in train for w in told(t)[order - 1 :])
    of = lambda counts: [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    d = {k: lm.discounts(*of(c.values())) for k, c in counts.items()}
    taken = lambda k, c: 0 if c == 0 else d[k][min(c, 3) - 1]
    total, freed = Counter(), Counter()
    for k in counts:
        for g, c in counts[k].items():
            total[k, g[:-1]] += c
            freed[k, g[:-1]] += taken(k, c)

    def p(ctx, w):
        k = len(ctx) + 1
        n = total[k, ctx]
        if k == 1:
            return max(counts[1][w,] - taken(1, counts[1][w,]), 0) / max(n, 1) + (freed[1, ()] / n if n else 1) / (len(uni) + 1)
        if not n:
            return p(ctx[1:], w)
        c = counts[k][*ctx, w]
        return max(c - taken(k, c), 0) / n + freed[k, ctx] / n * p(ctx[1:], w)

    n = sum(uni.values())
    out = []
    for t in texts:
        s = told(t)[order - 1 :]
        out.append((len(s), sum(uni[w] > 0 for w in s), n, sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in s), sum(math.log10(p(g[:-1], g[-1])) for g in grams(told(t)))))
    return out, p, list(uni)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(docs, monkeypatch, order):
    monkeypatch.setattr(lm, "HELD", 50)
    rng = random.Random(2)
    texts = [*ODD, *(" ".join(rng.choices("the of And cat dog runs".split() + [f"r{i}" for i in range(60)], [20] * 6 + [1] * 60, k=rng.randrange(1, 60))) for _ in range(40)), "never seen words"]
    df = docs(texts)
    model = lm.train(df, order=order, where=F.col("doc_id") % 3 != 2)
    assert model.order == order
    want, p, kinds = brute_lm([t for i, t in enumerate(texts) if i % 3 != 2], texts, order)
    got = {r.doc_id: r for r in lm.score(df, model, held_out=lambda i: i % 3 == 2).collect()}
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 3 == 2, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
        assert r.perplexity == pytest.approx(10 ** (-score / n))
    for v in ("<s>", "the", "cat", "unknown"):
        ctx = (*["<s>", "of", "the"][: order - 2], v)
        assert sum(p(ctx, w) for w in kinds) + p(ctx, "\0never") == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_of_nothing(docs, order):
    model = lm.train(docs([]), order=order)
    (r,) = lm.score(docs(["a b"]), model).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == pytest.approx(0) and r.base_score == pytest.approx(0)
    assert lm.score(docs([]), model).collect() == []


def test_order_of_one_is_refused(docs):
    with pytest.raises(ValueError):
        lm.train(docs([]), order=1)


@pytest.mark.parametrize("order", [2, 3])
def test_frequent_counts_are_kept(docs, order):
    rest = " ".join(f"a{i} go" for i in range(400))
    df = docs(["go " * 700 + "stop", rest, " ".join(f"b{i} go stop" for i in range(300))])
    want, _, _ = brute_lm(["go " * 700 + "stop", rest, " ".join(f"b{i} go stop" for i in range(300))], ["go go stop"], order)
    (r,) = lm.score(docs(["go go stop"]), lm.train(df, order=order)).collect()
    assert r.score == pytest.approx(want[0][4])


# chat


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seg": F.lit("x"), "loss": F.lit("y")})


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<<SYS>>\n<</SYS>>", "<<s>", "[\\INST]", "", "a\nb", "[ROLE x] y [/ROLE]", " </s> ", "<s", "日本"]


def test_chats_come_back(spark):
    rng = random.Random(4)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "we]ird\\", "[INST]", "", None]), rng.choice([*HARD, None])))
    df = conversations(spark, rows)
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    parser = chat.Parser(chat.LLAMA)
    whole = {r.conv_id: r.text for r in chat.joined(formatted).collect()}
    assert len(got) == 40
    for c, r in got.items():
        turns = [(role or "", text or "") for conv, _, role, text in rows if conv == c]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), len(whole[c]))
        assert list(parser.turns(whole[c])) == turns
        for text in (x for _, x in turns):
            escaped = chat.LLAMA.escape(text)
            assert not any(k in escaped for k in chat.LLAMA.controls) and chat.LLAMA.unescape(escaped) == text


@pytest.mark.parametrize("roles, valid", [("u", True), ("ua", True), ("sua", True), ("uaua", True), ("su", True), ("a", False), ("uu", False), ("s", False), ("usa", False), ("sa", False), ("ut", False)])
def test_turn_order(spark, roles, valid):
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    df = conversations(spark, [(1, i, names[r], "x") for i, r in enumerate(roles)])
    (r,) = chat.read_back(chat.format_chats(df)).collect()
    assert r.valid is valid


def test_order_ties_and_nulls(spark):
    df = conversations(spark, [(None, 1, "user", "b"), (None, None, "user", "z"), (None, 1, "user", "a"), (None, 1, None, "c"), (2, 0, "user", "r"), (2, 0, "user", "r")])
    segs = chat.format_chats(df).where("kind = 'text'").orderBy("conv_id", "seg").collect()
    assert [(s.conv_id, s.text) for s in segs] == [(None, "z"), (None, "c"), (None, "a"), (None, "b"), (2, "r"), (2, "r")]
    assert chat.read_back(chat.format_chats(df.limit(0))).collect() == []


# secrets

ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


def secret_texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=rng.randrange(2, 9)))
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    some = [lambda: f"password={hexa(18)}", lambda: f'Token = "{hexa(40)}"', lambda: "AKIA" + "".join(rng.choices("ABCDEFGH0123456789", k=16)), lambda: f"é api_key: '{hexa(30)}'", lambda: f"secret:short {hexa(23)}", lambda: f"passwd=abc ſecret=abcdefgh AKIASHORT {hexa(24)}"]
    return [" ".join([*(word() for _ in range(rng.randrange(14, 40))), *([rng.choice(some)()] if rng.random() < 0.7 else []), *(word() for _ in range(12))]) for _ in range(n)]


def test_patterns(docs):
    texts = [*ODD, *secret_texts(60, 1), "f" * 30, "password=" + "x" * 20000, "token=token=abcdef", "AKIA" + "A" * 16 + "é" + "0" * 24, "token = ", "a\npassword=\nabcdef"]
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in secrets.scan_secrets(docs(texts), None).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_field(docs):
    df = docs(secret_texts(300, 2))
    field = secrets.train(df)
    assert secrets.train(docs(["nothing here"] * 5)) is None
    texts = [*ODD, *secret_texts(80, 3)]
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in secrets.scan_secrets(docs(texts), field).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] != "crf"] == base(t)
        assert got[i] == sorted(got[i], key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    # held out: words that the field tags, against those that the patterns touch
    import pyarrow as pa

    hit = miss = wrong = 0
    for t in secret_texts(80, 3):
        w = secrets.words(pa.array([t]))
        scores = field.scores(secrets.features(w))
        tags = field.decode(scores, w.first)
        assert (tags == field._viterbi(scores)).all()
        raw = t.encode()
        spans = [(len(t[:a].encode()), len(t[:b].encode())) for _, a, b in base(t)]
        want = np.array([any(s < e2 and e > s2 for s2, e2 in spans) for s, e in zip(w.start, w.end, strict=True)])
        assert len(raw) == len(w.raw)
        hit += int((want & (tags > 0)).sum())
        miss += int((want & (tags == 0)).sum())
        wrong += int((~want & (tags > 0)).sum())
    assert hit / (hit + miss) > 0.85 and wrong < 0.2 * hit


# languages

SAMPLES = {"en": "the cat and the dog are in the house with this and that because they were there when it rained ", "de": "der hund und die katze sind nicht in dem haus weil sie nicht wissen dass es dort regnet und schneit ", "fr": "le chat et le chien sont dans la maison parce que nous avons mis de la nourriture pour eux hier soir "}


def brute_language(rows, labelled):
    """rows: id, text, declared, suffix, host, domain."""
    import pyarrow as pa

    labels = sorted({x for _, x in labelled if x})
    k = len(labels) + 1
    counts = np.full((k, language.BUCKETS), 1.0)
    for i, name in enumerate(labels):
        counts[i] = language.SMOOTH
        for t, x in labelled:
            if x == name and t is not None:
                code, _ = language.grams(pa.array([t]))
                np.add.at(counts[i], code, 1)
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    ll, best, n = [], [], []
    for r in rows:
        code, _ = language.grams(pa.array([r[1]], pa.string()))
        s = logs[:, code].astype(float).sum(axis=1) * min(len(code), language.EFFECTIVE) / max(len(code), 1)
        ll.append(s)
        best.append(int(s.argmax()) if len(code) else k - 1)
        n.append(len(code))
    code_of = lambda x: labels.index(x) if x in labels else len(labels) if x else len(labels) + 1
    says = []
    for c in (2, 3):
        m = np.full((k, k + 1), language.EVIDENCE)
        for r, b in zip(rows, best, strict=True):
            m[b, code_of(r[c])] += 1
        says.append(np.log(m / m.sum(axis=1, keepdims=True)))
    g = (np.bincount(best, minlength=k) + 1) / (len(rows) + k)
    out = []
    for i, r in enumerate(rows):
        own = np.bincount([b for q, b in zip(rows, best, strict=True) if q[4:] == r[4:]], minlength=k) - np.eye(k)[best[i]]
        wide = np.bincount([b for q, b in zip(rows, best, strict=True) if q[5] == r[5]], minlength=k) - np.eye(k)[best[i]]
        domain = (wide + language.GLOBAL * g) / (wide.sum() + language.GLOBAL)
        host = (own + language.DOMAIN * domain) / (own.sum() + language.DOMAIN)
        post = ll[i] + np.log(host) + says[0][:, code_of(r[2])] + says[1][:, code_of(r[3])]
        names = [*labels, language.UND]
        out.append((r[0], names[best[i]], names[int(post.argmax())] if n[i] else language.UND, 1 / np.exp(post - post.max()).sum() if n[i] else 1.0))
    return out


def test_languages(spark, docs):
    rng = random.Random(5)
    labelled = [(SAMPLES[x], x) for x in SAMPLES for _ in range(3)] + [(None, "en"), ("unlabelled", None)]
    train = docs([t for t, _ in labelled], lang=[x for _, x in labelled])
    model = language.text_model(train)
    rows = []
    for i in range(60):
        x = rng.choice(list(SAMPLES))
        ws = SAMPLES[x].split()
        text = rng.choice([" ".join(rng.choices(ws, k=rng.randrange(1, 12))), None, "", "12 34 !!", "zqx kjw vvq xxq"])
        rows.append((i, text, rng.choice([x, "", None, "pt"]), rng.choice([x, None]), f"h{rng.randrange(4)}.{x}.net", f"{x}.net"))
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string")
    got = sorted(map(tuple, language.fuse(df, model).collect()))
    for g, w in zip(got, brute_language(rows, labelled), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-4)


def test_pages(spark, docs):
    train = docs([SAMPLES[x] for x in SAMPLES], lang=list(SAMPLES))
    pages = spark.createDataFrame([(1, "https://a.shop.de/x", f'<html lang="de"><script>var the = "and";</script><p>{SAMPLES["de"]}</p></html>'), (2, "http://b.net/fr/1?x=1", f"<html><!-- the --><b>{SAMPLES['fr']}</b>"), (3, None, None), (None, "nonsense", "<p>123</p>")], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    fields = {r.id: r for r in language.page_fields(pages).collect()}
    assert (fields[1].declared, fields[1].suffix, fields[1].host, fields[1].domain) == ("de", "de", "a.shop.de", "shop.de") and "var" not in fields[1].text
    assert (fields[2].declared, fields[2].suffix) == ("", "fr") and "the" not in fields[2].text
    got = {r.page_id: r.lang for r in language.identify_pages(pages, train).collect()}
    assert got == {1: "de", 2: "fr", 3: "und", None: "und"}
    assert language.identify_pages(pages.limit(0), train).collect() == []
    assert {r.lang for r in language.identify_pages(pages, train.limit(0)).collect()} == {"und"}


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    rows = test.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.lit("").alias("domain"))
    got = language.fuse(rows, language.text_model(train)).join(test.select(F.col("doc_id").alias("id"), F.col("lang").alias("want")), "id")
    assert got.where("lang = want").count() >= 0.95 * got.count()
    assert language.known_language(docs).columns == docs.columns


def test_rejected_documents(docs):
    df = docs([SAMPLES["en"], "", None, "1234 5678", SAMPLES["de"]], lang=["en", "en", "en", None, "de"])
    assert sorted(r.doc_id for r in language.known_language(df).collect()) == [0, 4]
    assert language.known_language(docs([])).collect() == []

def test_training_rows_are_bounded(docs):
    texts = [f"{'w ' * 20} password = hunter2hunter{i} {'x ' * 20}" if i % 2 else "plain words " * 20 for i in range(400)]
    rows = secrets.training_rows(docs(texts).select("doc_id", "text"), 40)
    every = secrets.training_rows(docs(texts).select("doc_id", "text"), 10**6)
    picks = sorted((r.hit, r.pick, bytes(r.f)) for r in every)
    assert len(rows) == 40 and sorted((r.hit, r.pick, bytes(r.f)) for r in rows) == sorted([p for p in picks if p[0]][:20] + [p for p in picks if not p[0]][:20])


def test_decoding_of_a_long_text_is_not_quadratic():
    rng = np.random.default_rng(1)
    field = secrets.Field(np.zeros((1, 3), np.float32), np.array([[0, -1, secrets._NEVER], [0, -1, 1], [0, -1, 1]], np.float32))
    took = []
    for n in (20_000, 80_000):
        s = np.zeros((n, 3), np.float32)
        s[:, 1:] = -9
        s[rng.random(n) < 0.05, 1:] = 3
        began = time.perf_counter()
        field.decode(s, np.array([0, n]))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.2


# licenses


def test_notices_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/src/x.py", "code\nmore code"),
        (3, "a/src/lib/y.py", "Licensed under the Apache License, Version 2.0.\ncode that goes on for long enough to be more than the notice itself is, which is what makes it a header and not a licence file of its own, and more"),
        (4, "b/z.py", "nothing"),
        (5, "a/src/lib/deep/q.py", None),
        (6, None, "This work is licensed under the GNU General Public License, version 3."),
        (7, "a/src/lib/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (None, "a/w.py", ""),
        (8, "top.py", "the licensed driver licensed a car"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string").withColumns({"path": F.lit("clash"), "dir": F.lit(1)})
    got = {r.doc_id: r for r in licenses.scan_licenses(df, F.col("p")).collect()}
    assert {i: (r.license, r.inherited, r.inherited_from) for i, r in got.items()} == {
        1: ("MIT", None, None), 2: (None, "MIT", "a"), 3: ("Apache-2.0", None, None), 4: (None, None, None), 5: (None, "GPL-3.0", "a/src/lib"),
        6: ("GPL-3.0", None, None), 7: ("GPL-3.0", None, None), None: (None, "MIT", "a"), 8: (None, None, None),
    }
    assert licenses.scan_licenses(df.limit(0), F.col("p")).collect() == []


WRAPPED = {
    "MIT": "/*\n * Copyright (c) 2020 X\n *\n * Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this\n * software and associated documentation files, to deal in it without restriction\n */\nint x;",
    "BSD-3-Clause": "Copyright (c) 2020, X. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "GPL-3.0": "# This program is distributed under the terms of the GNU General\n# Public License as published by the Free Software\n# Foundation, either version 3 of the License, or any later one.",
    "GPL-2.0": "# This program is distributed under the terms of the GNU General\n# Public License as published by the Free Software\n# Foundation, either version 2 of the License, or any later one.",
    "Unlicense": "This is free and unencumbered\nsoftware released into the\npublic domain.\n\nAnyone is free to copy it.",
    "Proprietary": "Copyright 2020 X. All\nrights\nreserved.",
}


def test_wrapped_notices(spark):
    plain = ["the work of a day is in this with no end and by the way it was to be", "free software is a matter of the people who write it", "use of water in the town", "the right to be granted a day off is in the law", ""]
    df = spark.createDataFrame([(i, f"d{i}/x.c", t) for i, t in enumerate([*WRAPPED.values(), *plain * 8])], "doc_id long, p string, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(df, F.col("p")).collect()}
    assert got == dict(enumerate([*WRAPPED, *[None] * len(plain) * 8]))


def brute_windows(text, judge, n_docs, df):
    """All windows of all notices, by lists and dictionaries: best cosine for each license."""
    idf = {t: math.log((1 + n_docs) / (1 + df.get(t, 0))) + 1 for t in judge.vocabulary.terms}
    other = math.sqrt(sum(x * x for x in idf.values()) / len(idf))
    vec = lambda ts: {t: c * idf.get(t, other) for t, c in Counter(ts).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own, best = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower()), {}
    for name, ts in licenses.notices_of(licenses.TEMPLATES):
        t, m = vec(ts), len(ts)
        for size in {m, (m + 1) // 2} if m >= licenses.LONG else {m}:
            for i in range(len(own)):
                part = own[i : i + size]
                if len(part) >= max(licenses.LEAST, (m + 1) // 2):
                    v = vec(part)
                    c = sum(x * t.get(k, 0) for k, x in v.items()) / norm(v) / norm(t)
                    if c >= licenses.COSINE:
                        best[name] = max(best.get(name, 0.0), c)
    return best


def test_licenses_against_brute_force(spark):
    rng = random.Random(5)
    pool = [t for vs in licenses.TEMPLATES.values() for v in vs for t in v.split()]
    texts = [None, "", "one"]
    for i in range(60):
        name = rng.choice(list(licenses.TEMPLATES))
        v = rng.choice(licenses.TEMPLATES[name]).split()
        a = rng.randrange(max(1, len(v) // 2))
        notice = [w for w in v[a : a + rng.randrange(4, 60)] if rng.random() > 0.1]
        noise = lambda k: [rng.choice([*pool, "of", "the", f"x{rng.randrange(50)}"]) for _ in range(k)]
        texts.append("\n".join([" ".join(noise(rng.randrange(30))), " ".join(notice), " ".join(noise(rng.randrange(30)))]))
    dirs = ["", "a", "a/b", "a/b/c", "a/d", "e/f/g"]
    paths = [f"{rng.choice(dirs)}/{rng.choice(['LICENSE', 'x.py', 'y.c', 'COPYING.txt'])}".lstrip("/") if rng.random() > 0.05 else None for _ in texts]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(zip(paths, texts, strict=True))], "doc_id long, p string, text string").repartition(3)
    known = licenses.Vocabulary(licenses.TEMPLATES)
    words_of = [set(licenses.terms(t or "")) for t in texts]
    counts = {t: sum(t in w for w in words_of) for t in known.terms}
    assert licenses.frequencies(df, known) == (len(texts), counts)
    judge = licenses.Judge(licenses.TEMPLATES, len(texts), counts)
    own = {}
    for i, t in enumerate(texts):
        best = brute_windows(t, judge, len(texts), counts)
        free = {k: c for k, c in best.items() if k != licenses.RESERVED} or best
        own[i] = max(((round(c, 9), k) for k, c in free.items()), default=(0.0, None))
    got = {r.doc_id: r for r in licenses.scan_licenses(df, F.col("p")).collect()}
    assert len(got) == len(texts) and sum(x[1] is not None for x in own.values()) > 30
    for i, (c, k) in own.items():
        assert got[i].license == k and got[i].cosine == pytest.approx(c, abs=1e-8), texts[i]
    # inheritance: walk up from each file
    share = {i: s for i, (_, _, s) in enumerate(judge.judged(pa.array(texts, pa.large_string())))}
    given = {}
    for i, p in enumerate(paths):
        if p is not None and own[i][1] and (re.search(r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$", p) or share[i] >= 0.5):
            d = p.rpartition("/")[0]
            given[d] = max(given.get(d, (0.0, "")), own[i])
    for i, p in enumerate(paths):
        want = (None, None)
        if p is not None and own[i][1] is None:
            d = p.rpartition("/")[0]
            while d not in given and d:
                d = d.rpartition("/")[0]
            want = (given[d][1], d) if d in given else want
        assert (got[i].inherited, got[i].inherited_from) == want, p


def test_sentences_are_found_without_titles(spark):
    rows = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This is free and unencumbered software released into the public domain", "Redistribution and use in source and binary forms, with or without modification, are permitted"]
    df = spark.createDataFrame([(i, f"d{i}/x.c", t) for i, t in enumerate([*rows, *["words of no licence at all"] * 20])], "doc_id long, p string, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(df, F.col("p")).collect()}
    assert [got[i] for i in range(4)] == ["MIT", "Unlicense", "BSD-3-Clause", None]


def test_every_notice_finds_itself():
    judge = licenses.Judge(licenses.TEMPLATES, 0, {})
    for name, text in ((k, v) for k, vs in licenses.TEMPLATES.items() for v in vs):
        ((found, cosine, share),) = judge.judged(pa.array(["before it " + text + " and after"]))
        assert cosine == pytest.approx(1, abs=1e-6) and (found == name or text.count(" ") > 10) and share > 0.3


# mixture


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(out[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
        full |= over


def test_mixture(docs):
    rng = random.Random(6)
    texts, sources = [], []
    for s, n in (("a", 80), ("b", 5), ("c", 40), ("é", 3), (None, 30), ("B", 1)):
        for _ in range(n):
            texts.append(" ".join(["w"] * rng.choice([1, 2, 3, 5, 8, 13, 40, 100])))
            sources.append(s)
    texts += ["", None, " \t"]
    sources += ["a", "c", "zero"]
    df = docs(texts, source=sources)
    got = mixture.mix(df).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    by = Counter()
    for i, s in enumerate(sources):
        by[s] += sizes[i]
    want = brute_targets(by)
    taken = Counter()
    assert len(got) == len(texts)
    for r in got:
        s = sources[r.doc_id]
        assert (r["size"], r.source_size) == (sizes[r.doc_id], by[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.02 * t)
    again = {r.doc_id: r.copies for r in mixture.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_rates_are_exponential(spark, docs):
    """Within a source the rates before rounding are one exponential of size: the dual is solved."""
    sizes = spark.createDataFrame([("a", 10, 100, 0.5), ("a", 20, 100, 1.0), ("a", 40, 50, 2.0), ("b", 10, 10, 1.0)], "source string, size long, n long, x double")
    goal = spark.createDataFrame([("a", 5000, 2500.0), ("b", 100, 300.0)], "source string, source_size long, target double")
    l = {r.source: r.l for r in mixture.multipliers(sizes, goal).collect()}
    assert sum(n * s * math.exp(l["a"] * x) for s, n, x in ((10, 100, 0.5), (20, 100, 1.0), (40, 50, 2.0))) == pytest.approx(2500)
    assert min(3, math.exp(l["b"])) == pytest.approx(3, rel=1e-6)


def test_mixture_of_odd_rows(docs):
    got = mixture.mix(docs(ODD, [None, *range(len(ODD) - 1)], source=["s", None] * 5)).collect()
    assert len(got) == len(ODD) and all(r.copies <= 3 for r in got)
    assert mixture.mix(docs([])).collect() == []
    one = mixture.mix(docs(["a b", "a b"], [1, 1])).collect()
    assert sum(r.taken for r in one) == 4
