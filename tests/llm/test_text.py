import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from llm.exact import golomb, ungolomb
from llm.text import covered, pieces, windows, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB 0\n\té日\x0b-", max_size=40)), max_size=8)
PATTERN = {"space": r"[^\x20\x09-\x0D]+", "plain": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def split(text, kind, lower):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [x.encode() for x in re.findall(PATTERN[kind], text)]


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from(["space", "plain"]), st.booleans())
def test_words(texts, kind, lower):
    w = words(pa.array(texts, pa.string()), kind, lower)
    got = [[w.word(i) for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [split(t, kind, lower) for t in texts]
    flat = [x for d in got for x in d]
    h = w.hashes()
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_windows(texts, n):
    w = words(pa.array(texts, pa.string()))
    got, at = windows(w.hashes(), w.first, n)
    flat = [w.word(i) for i in range(len(w))]
    want = [i for d in range(len(texts)) for i in range(w.first[d], w.first[d + 1] - n + 1)]
    assert at.tolist() == want
    keys = [tuple(flat[i : i + n]) for i in want]
    assert len(set(zip(keys, got.tolist(), strict=True))) == len(set(keys)) == len(set(got.tolist()))


def test_hashes_do_not_depend_on_the_batch():
    texts = ["alpha beta", "gamma " * 50, "alpha"]
    whole = words(pa.array(texts)).hashes()
    parts = np.concatenate([words(pa.array([t])).hashes() for t in texts])
    sliced = words(pa.array(["pad pad", *texts])[1:]).hashes()
    assert (whole == parts).all() and (whole == sliced).all()


def test_pieces_cover_all():
    texts = pa.array(["x" * 10, None, "y" * 100, "", "z" * 5])
    assert list(pieces(texts, 20)) == [(0, 2), (2, 3), (3, 5)]
    assert list(pieces(pa.array([], pa.string()))) == []


def test_covered():
    assert covered(np.array([1, 2]), 3, 7).tolist() == [False, True, True, True, True, False, False]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**48 - 1), max_size=60), st.booleans())
def test_golomb(values, dense):
    v = np.array(sorted({x % 500 for x in values} if dense else values), np.uint64)
    assert (ungolomb(golomb(v)) == v).all()


def test_golomb_is_short():
    v = np.sort(np.random.default_rng(1).integers(0, 2**48, 10_000).astype(np.uint64))
    assert len(golomb(v)) < 10_000 * 38 / 8  # 48 - log2(10,000) + about 1.5 bits, where plain values take 48
