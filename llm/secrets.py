"""Secret scans: fixed patterns, and a linear-chain conditional random field over words.

Words get tags outside, begin and inside. A word's features are its shape (length, shares of digits, capitals and other
classes, changes of class), whether it holds or follows a key word or an assignment sign, the shapes of its neighbours,
and features of the file: its size and its share of words with digits. The field is fitted by gradient ascent on the
regularised likelihood, with forward and backward sums over short sequences. Its labels are what the patterns find; so
that it does not only learn the patterns, key-word features are hidden in half of the sequences.

Decoding is Viterbi's. Most words of a text cannot be part of any tagged run: a bound on what a run can gain over
"outside" shows where runs are possible, and only these places are decoded. The result is that of decoding everything.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from llm.cluster import internal, saved, ship
from llm.text import Words, pieces, words

#: Patterns of the base, in the order in which kinds are listed.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_KEYS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Sequences that are fitted at most, half of them around what the patterns find; words in each.
SEQUENCES, LENGTH = 4000, 13
OUT, BEGIN, IN = 0, 1, 2

_LUT = np.zeros((5, 256), bool)
_LUT[0, 0x30:0x3A] = True
_LUT[1, 0x61:0x7B] = True
_LUT[2, 0x41:0x5B] = True
_LUT[3] = _LUT[0] | (np.isin(np.arange(256), list(b"abcdef")))
_LUT[4, list(b"+/_=-\"':;@")] = True
_CLASS = np.where(_LUT[0], 1, np.where(_LUT[1], 2, np.where(_LUT[2], 3, 4))).astype(np.uint8)

#: Feature columns and how many values each has. Own shape, flags, neighbours' shapes, file.
_WIDTH = [8, 5, 4, 4, 6, 8, 48, 48, 48, 6, 4]
FIRST = np.cumsum([0, *_WIDTH])
_KEYED = (5,)


def _share(part: np.ndarray, whole: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), part / np.maximum(whole, 1), side="left")


def features(w: Words) -> np.ndarray:
    """A row of feature numbers for each word."""
    n = len(w)
    if not n:
        return np.zeros((0, len(_WIDTH)), np.int32)
    size = w.end - w.start
    counts = []
    for t in _LUT:
        run = np.concatenate(([0], np.cumsum(t[w.raw], dtype=np.int64)))
        counts.append(run[w.end] - run[w.start])
    digit, lower, upper, hexa, sign = counts
    cls = _CLASS[w.raw]
    change = np.concatenate(([0], np.cumsum(cls[1:] != cls[:-1]), [0]))
    change[-1] = change[-2] if len(change) > 1 else 0
    changes = change[w.end - 1] - change[w.start]
    length = np.searchsorted([3, 7, 11, 15, 19, 31, 63], size)
    digits = _share(digit, size, (0.0, 0.1, 0.3, 0.6))
    uppers = _share(upper, size, (0.0, 0.3, 0.8))
    signs = np.minimum(sign, 3)
    changing = np.minimum(np.searchsorted([0, 1, 3, 6, 12], changes), 5)
    hexish = (hexa >= 0.9 * size) & (size >= 8)
    # key words are looked for in the few words that may hold one: those with an assignment sign or a neighbour that has
    raw = w.raw.tobytes()
    low = raw.lower()
    key = np.zeros(n, bool)
    for k in _KEYS:
        at = low.find(k)
        while at >= 0:
            i = int(np.searchsorted(w.start, at, "right")) - 1
            key[i] = True
            at = low.find(k, at + 1)
    eq = np.concatenate(([0], np.cumsum((w.raw == 0x3D) | (w.raw == 0x3A))))
    assigns = (eq[w.end] - eq[w.start]) > 0
    text = w.text_of()

    def before(x, k):
        out = np.zeros_like(x)
        out[k:] = x[:-k] if k else x
        out[k:][text[k:] != text[:-k]] = 0
        return out

    def after(x, k):
        out = np.zeros_like(x)
        out[:-k] = x[k:]
        out[:-k][text[:-k] != text[k:]] = 0
        return out

    flags = key * 1 + assigns * 2 + (before(key, 1) | before(key, 2)) * 4
    brief = np.minimum(length, 5) * 8 + (digits > 0) * 4 + (uppers > 0) * 2 + hexish
    per = np.maximum(np.diff(w.first), 1)
    with_digit = np.concatenate(([0], np.cumsum(digit > 0)))
    rate = (with_digit[w.first[1:]] - with_digit[w.first[:-1]]) / per
    file_rate, file_size = np.searchsorted([0.0, 0.01, 0.03, 0.1, 0.3], rate), np.searchsorted([30, 300, 3000], per)
    cols = [length, digits, uppers, signs, changing, flags, brief, before(brief, 1), after(brief, 1), file_rate[text], file_size[text]]
    return np.stack([c + f for c, f in zip(cols, FIRST[:-1], strict=True)], axis=1).astype(np.int32)


class Field:
    """Weights of features by tag, and of tags by the tag before; begin comes after any, inside after begin or inside."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def scores(self, f: np.ndarray) -> np.ndarray:
        out = np.zeros((len(f), 3), np.float32)
        for c in range(f.shape[1]):
            out += self.weights[f[:, c]]
        return out

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of each text."""
        tags = np.zeros(len(scores), np.int8)
        gain = self.moves - self.moves[OUT, OUT]
        extra = max(0.0, float(np.max(gain[np.isfinite(gain)])))
        most = np.maximum(scores[:, BEGIN], scores[:, IN]) - scores[:, OUT] + extra
        hot = np.flatnonzero(most > -extra)
        # what all words of a text could gain at most; the margin covers that sums of many terms are rounded
        gains = np.concatenate(([0.0], np.cumsum(np.maximum(most, 0), dtype=np.float64)))
        done = -1
        for i in hot:
            if i <= done:
                continue
            d = int(np.searchsorted(first, i, "right")) - 1
            lo, hi = int(first[d]), int(first[d + 1])
            limit = -(float(gains[hi] - gains[lo]) + extra + 1e-9 * float(gains[hi]) + 1e-6)
            a = b = int(i)
            left = right = 0.0
            while a > max(lo, done + 1) and left > limit:
                a -= 1
                left += float(most[a])
            while b < hi - 1 and right > limit:
                b += 1
                # another hot word starts the count anew
                right = 0.0 if most[b] > -extra else right + float(most[b])
            tags[a : b + 1] = self._viterbi(scores[a : b + 1])
            done = b
        return tags

    def _viterbi(self, s: np.ndarray) -> np.ndarray:
        best, back = self.moves[OUT] + s[0], []
        for row in s[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        tag = int((best + self.moves[:, OUT]).argmax())
        out = [tag]
        for k in reversed(back):
            tag = int(k[tag])
            out.append(tag)
        return np.array(out[::-1], np.int8)


_NEVER = -1e4


def fit(f: np.ndarray, tags: np.ndarray, steps: int = 150, rate: float = 0.2, l2: float = 2e-3) -> Field:
    """f: sequences x words x features; tags: sequences x words. Adam on the mean log likelihood."""
    n, length, _ = f.shape
    w, m = np.zeros((FIRST[-1], 3)), np.zeros((3, 3))
    mask = np.zeros((3, 3))
    mask[OUT, IN] = _NEVER
    one = np.eye(3)[tags]
    seen_w = np.zeros_like(w)
    for c in range(f.shape[2]):
        np.add.at(seen_w, f[:, :, c].ravel(), one.reshape(-1, 3))
    seen_m = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:])
    mean, var = [np.zeros_like(w), np.zeros_like(m)], [np.zeros_like(w), np.zeros_like(m)]
    for step in range(1, steps + 1):
        e = sum(w[f[:, :, c]] for c in range(f.shape[2]))
        mm = m + mask
        alpha = np.empty((n, length, 3))
        alpha[:, 0] = e[:, 0] + mm[OUT]
        for t in range(1, length):
            alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + mm, axis=1) + e[:, t]
        beta = np.zeros((n, length, 3))
        for t in range(length - 2, -1, -1):
            beta[:, t] = np.logaddexp.reduce(mm + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + mm + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        got = np.zeros_like(w)
        for c in range(f.shape[2]):
            np.add.at(got, f[:, :, c].ravel(), p.reshape(-1, 3))
        for x, g, a, v in ((w, (seen_w - got) / n - l2 * w, 0, 0), (m, (seen_m - pair) / n - l2 * m, 1, 1)):
            mean[a] = 0.9 * mean[a] + 0.1 * g
            var[v] = 0.99 * var[v] + 0.01 * g * g
            x += rate * (mean[a] / (1 - 0.9**step)) / (np.sqrt(var[v] / (1 - 0.99**step)) + 1e-8)
    return Field(w.astype(np.float32), (m + mask).astype(np.float32))


def base_spans(raw: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text, what the patterns find: start and end in bytes of the text, kind."""
    data, out = raw.tobytes(), [[] for _ in range(len(off) - 1)]
    low = data.lower()
    for kind, keys, where, pattern in ((0, _KEYS, low, ASSIGN), (1, (b"AKIA",), data, ACCESS)):
        texts: set[int] = set()
        for k in keys:
            at = where.find(k)
            while at >= 0:
                d = int(np.searchsorted(off, at, "right")) - 1
                texts.add(d)
                at = where.find(k, int(off[d + 1]))
        for d in sorted(texts):
            for m in pattern.finditer(data[off[d] : off[d + 1]]):
                if len(m[2] if kind == 0 else m[0]) >= LEAST[KINDS[kind]]:
                    out[d].append((m.start(), m.end(), kind))
    inside = np.concatenate(([False], _LUT[3][raw], [False]))
    edge = inside[1:] != inside[:-1]
    flips = np.flatnonzero(edge)
    start, end = flips[::2], flips[1::2]
    for i in np.flatnonzero(end - start >= LEAST["hex"]):
        a, b = int(start[i]), int(end[i])
        cuts = off[(off > a) & (off < b)].tolist()  # a run may go on over the edge of a text
        for x, y in zip([a, *cuts], [*cuts, b], strict=True):
            if y - x >= LEAST["hex"]:
                d = int(np.searchsorted(off, x, "right")) - 1
                out[d].append((x - int(off[d]), y - int(off[d]), 2))
    return [sorted(s, key=lambda t: (t[0], t[2])) for s in out]


def _offsets(w: Words, texts: pa.Array) -> np.ndarray:
    lengths = np.fromiter((0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()), np.int64, len(texts))
    return np.concatenate(([0], np.cumsum(lengths)))


def training_rows(docs: DataFrame, sequences: int = SEQUENCES) -> list:
    """Sequences of feature numbers and tags: half around spans of the patterns, half anywhere, those with the smallest
    hashes. The corpus is scanned once and what could be chosen is written; a histogram of its hashes shows which part of it
    comes to the driver, so that this is little more than is asked for, however many tasks there are."""

    def scan(batches):
        for batch in batches:
            for i, j in pieces(batch.column(1)):
                part = batch.slice(i, j - i)
                w = words(part.column(1))
                off = _offsets(w, part.column(1))
                spans = base_spans(w.raw, off)
                rows = []
                f = None
                for d, (doc, own) in enumerate(zip(part.column(0).to_pylist(), spans, strict=True)):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    pick = int(hashlib.blake2b(str(doc).encode(), digest_size=8).hexdigest(), 16)
                    if b - a < LENGTH or not own and pick % 16:
                        continue
                    if f is None:
                        f = features(w)
                    tags = np.zeros(b - a, np.int8)
                    for s, e, _ in own:
                        k = np.flatnonzero((w.end[a:b] > s + off[d]) & (w.start[a:b] < e + off[d]))
                        tags[k], tags[k[:1]] = IN, BEGIN
                    at = {int(np.clip(np.flatnonzero(tags)[0] - LENGTH // 2, 0, b - a - LENGTH))} if own and tags.any() else set()
                    at.add(pick % (b - a - LENGTH + 1))
                    for x in at:
                        t = tags[x : x + LENGTH]
                        rows.append((bool(t.any()), (pick ^ x) & (2**62 - 1), f[a + x : a + x + LENGTH].tobytes(), t.tobytes()))
                cols = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["hit", "pick", "f", "tags"])

    found = saved(docs.mapInArrow(scan, "hit boolean, pick long, f binary, tags binary"), "sequences")
    out = []
    for hit in (True, False):
        own = found.where(F.col("hit") == hit)
        upto = 1 << 62
        if (n := own.count()) > sequences:
            # bins that hold a sixteenth of what is asked for, on average
            width = max(1, (1 << 62) * sequences // 32 // n)
            bins = own.where(F.col("pick") < width * 64).groupBy(F.floor(F.col("pick") / width).alias("bin")).count().orderBy("bin").collect()
            seen = 0
            for r in bins:
                seen += r["count"]
                if seen >= sequences // 2:
                    upto = width * (r.bin + 1)
                    break
        # a pick is by document, so repeated rows share it; the limit holds if many do
        out += own.where(F.col("pick") < upto).orderBy("pick", "f").limit(sequences // 2).collect()
    return out


def train(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", sequences: int = SEQUENCES) -> Field | None:
    """Fit on at most so many sequences; None if the patterns find nothing to learn from."""
    ship(docs.sparkSession)
    rows = training_rows(internal(docs, doc_id=doc_id, text=text), sequences)
    if not any(r.hit for r in rows):
        return None
    rows.sort(key=lambda r: (r.pick, bytes(r.f)))
    f = np.stack([np.frombuffer(r.f, np.int32).reshape(LENGTH, -1) for r in rows]).copy()
    tags = np.stack([np.frombuffer(r.tags, np.int8) for r in rows])
    for c in _KEYED:
        f[::2, :, c] = FIRST[c]
    return fit(f, tags)


_FOUND = "doc_id long, spans array<struct<kind:string,start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def scan_secrets(docs: DataFrame, field: Field | None, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id and spans by start, then kind: those of the patterns, and runs that the field
    tags (kind crf) where they touch none of these, without quotes and stops around them. Offsets count code points, stop
    is exclusive.

    Null and empty texts have no spans; null ids and repeated rows are scanned like others. Other columns are left aside.
    Without a field only the patterns are used.
    """
    ship(docs.sparkSession)

    def scan(batches):
        for batch in batches:
            for i, j in pieces(batch.column(1)):
                part = batch.slice(i, j - i)
                w = words(part.column(1))
                off = _offsets(w, part.column(1))
                spans = base_spans(w.raw, off)
                if field is not None and len(w):
                    tags = field.decode(field.scores(features(w)), w.first)
                    for a in np.flatnonzero(tags == BEGIN):
                        b = int(a) + 1
                        d = int(np.searchsorted(w.first, a, "right")) - 1
                        while b < w.first[d + 1] and tags[b] == IN:
                            b += 1
                        x, y = int(w.start[a]), int(w.end[b - 1])
                        own = w.raw[x:y].tobytes()
                        x, y = x + len(own) - len(own.lstrip(b"\"'(<[{,;")), y - len(own) + len(own.rstrip(b"\"')>]},;."))
                        x, y = x - int(off[d]), y - int(off[d])
                        if x < y and not any(s < y and x < e for s, e, k in spans[d] if k < 3):
                            spans[d].append((x, y, 3))
                out = []
                for d, own in enumerate(spans):
                    if own:
                        own = sorted(own, key=lambda t: (t[0], t[2]))
                        chars = np.concatenate(([0], np.cumsum((w.raw[off[d] : off[d + 1]] & 0xC0) != 0x80)))
                        own = [{"kind": KINDS[k], "start": int(chars[s]), "stop": int(chars[e])} for s, e, k in own]
                    out.append(own)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, _SPANS)], ["doc_id", "spans"])

    return internal(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _FOUND)


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(said(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
