"""Interpolated modified Kneser-Ney model of n-grams, counted in Spark and scored from memory-mapped sorted hash arrays.

Training. Tasks count the n-grams of their documents and send each owner one block, sorted by context and coded in planes
of bytes. An owner adds up the counts of its grams, writes them to the shared folder as a sorted array of 64-bit hashes
with arrays of counts, and sends what the next shorter grams need (as a context: how often, and with how many words once,
twice, or more; as a gram: after how many different words) to their owners, which do the same, down to single words.
The successors of one context are dealt to several owners, so a frequent word is no hot key. Only sums come to the driver.

Scoring. A task maps the arrays and looks the sorted hashes of a piece of text up; nothing is shuffled.

Probabilities. Each text has n - 1 starts before it and one end. With c(g) the count of an n-gram and, for a shorter gram,
the number of different words before it, and c(h.) the sum over the words after h:
    p1(w) = max(c(w) - D1(c(w)), 0) / c(.) + g / (V + 1), V different tokens, where the g's are what the discounts leave
    pk(w|h) = max(c(hw) - Dk(c(hw)), 0) / c(h.) + g(h) pk-1(w|h without its first word); after a context never seen, pk-1
The last class of p1 is for words never seen, so all of it sums to 1.

Words are known by 64-bit hashes where tokens are counted, and by 48 of these bits within grams.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from llm.cluster import internal, partitions, shared_dir, ship
from llm.files import Files, qualified
from llm.text import mix, pieces, words

U = np.uint64
#: The end of a text, a token, and its start, a context only. Words' hashes come from a bijection of other values.
END, START = U(0xE0D0_0000_51F1_7A3B), U(0x57A2_0000_9C4D_11E5)
#: Tokens that a task holds before it counts and sends them.
HELD = 2_000_000
#: Owners among which the successors of one context are dealt.
SPREAD = 8


def remainder(doc_id: object, parts: int = 7) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def _planes(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplanes(b: bytes, size: int) -> np.ndarray:
    part = np.frombuffer(b, np.uint8).reshape(size, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :size] = part.T
    return out.view("<u8").ravel()


def sequences(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts with n - 1 starts before and an end after each, and where each text's tokens begin when starts are left out."""
    at = np.repeat(first[:-1], n).reshape(-1, n)
    at[:, -1] = first[1:]
    marks = np.full(at.shape, START)
    marks[:, -1] = END
    return np.insert(h, at.ravel(), marks.ravel()), first + np.arange(len(first))


def gram_key(grams: list[np.ndarray]) -> np.ndarray:
    """Of 48-bit words."""
    key = mix(grams[0] + U(1))
    for w in grams[1:]:
        key = mix(key + w)
    return key


@dataclass(frozen=True)
class Layout:
    """Which owner has what."""

    owners: int

    @property
    def spread(self) -> int:
        return min(SPREAD, self.owners)

    def owner(self, grams: list[np.ndarray]) -> np.ndarray:
        """Words by their range. Grams by the words before the last, whose successors are dealt to several owners; a
        pair's first word by its range too, so that few owners of pairs have something for one owner of words."""
        *before, tok = grams
        if not before:
            return (((tok >> U(16)) * U(self.owners)) >> U(32)).astype(np.int64)
        ctx = before[0] >> U(16) if len(before) == 1 else gram_key(before) >> U(32)
        base = (ctx * U(self.owners // self.spread)) >> U(32)
        return (base * U(self.spread) + tok % U(self.spread)).astype(np.int64)


def _split(owner: np.ndarray, owners: int):
    edge = np.searchsorted(owner, np.arange(owners + 1))
    return [(o, int(a), int(b)) for o, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    if not len(k):
        return (k, *values)
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return (k[at], *(np.add.reduceat(v[order], at) for v in values))


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _packed(keys: np.ndarray, values: list[np.ndarray]) -> bytes:
    """Sorted keys, and columns of counts: a byte each, from 255 on in a list."""
    big = [np.flatnonzero(c >= 255) for c in values]
    head = np.array([len(keys), *map(len, big)], np.int64)
    lists = b"".join(at.astype(np.int64).tobytes() + c[at].astype(np.int64).tobytes() for at, c in zip(big, values, strict=True))
    return head.tobytes() + keys.tobytes() + lists + b"".join(np.minimum(c, 255).astype(np.uint8).tobytes() for c in values)


def _unpacked(m: memoryview, columns: int):
    n, *big = (int(x) for x in np.frombuffer(m, np.int64, 1 + columns))
    at = 8 * (1 + columns)
    keys, at, lists = np.frombuffer(m, U, n, at), at + 8 * n, []
    for k in big:
        lists.append((np.frombuffer(m, np.int64, k, at), np.frombuffer(m, np.int64, k, at + 8 * k)))
        at += 16 * k
    return keys, [(np.frombuffer(m, np.uint8, n, at + i * n), *x) for i, x in enumerate(lists)]


def _counts(column, k: np.ndarray) -> np.ndarray:
    small, at, value = column
    c = small[k].astype(np.int64)
    if (hot := c == 255).any():
        c[hot] = value[np.searchsorted(at, k[hot])]
    return c


_FIELDS = "part string, kind string, level int, owner int, ctx binary, runs binary, keys binary, counts binary, c1 long, c2 long, c3 long, c4 long, n long"
_SUMS = "level int, c1 long, c2 long, c3 long, c4 long, n long, more long, tokens long, kinds long"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(rows: list[tuple], fields: str) -> pa.Table:
    names = [x.split() for x in fields.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, names, strict=True)], [n for n, _ in names])


def _row(part: str, kind: str, level: int, owner: int, keys: bytes = b"", counts: bytes = b"", ctx: bytes = b"", runs: bytes = b"", sums: tuple = (0, 0, 0, 0, 0)) -> tuple:
    return (part, kind, level, owner, ctx, runs, keys, counts, *sums)


def _blocks(grams: list[np.ndarray], c: np.ndarray, layout: Layout) -> list[tuple]:
    """Distinct grams and their counts for each owner; words before the last are sent once for each run of their successors."""
    *before, tok = grams
    k = len(grams)
    if not before:
        order = np.argsort(tok)
        tok, c = tok[order], c[order]
        return [_row("gram", "tok", 1, o, _planes(tok[a:b], 6), _planes(c[a:b], 8)) for o, a, b in _split(layout.owner([tok]), layout.owners)]
    ctx = gram_key(before)
    owner = layout.owner(grams)
    order = np.lexsort((tok, ctx, owner))
    before, tok, c, ctx, owner = [w[order] for w in before], tok[order], c[order], ctx[order], owner[order]
    rows = []
    for o, a, b in _split(owner, layout.owners):
        new = np.flatnonzero(np.concatenate(([True], ctx[a + 1 : b] != ctx[a : b - 1])))
        runs = np.diff(np.append(new, b - a))
        rows.append(_row("gram", "tok", k, o, _planes(tok[a:b], 6), _planes(c[a:b], 8), b"".join(_planes(w[a:b][new], 6) for w in before), _planes(runs, 4)))
    return rows


def _grams(ctx: list[bytes], runs: list[bytes], keys: list[bytes], k: int) -> list[np.ndarray]:
    tok = np.concatenate([_unplanes(x, 6) for x in keys])
    times = [_unplanes(r, 4).astype(np.int64) for r in runs]
    size = [6 * len(t) for t in times]
    return [*(np.concatenate([np.repeat(_unplanes(x[i * s : (i + 1) * s], 6), t) for x, s, t in zip(ctx, size, times, strict=True)]) for i in range(k - 1)), tok]


def _distinct(keys: np.ndarray, grams: list[np.ndarray], *values: np.ndarray) -> tuple:
    """Sorted distinct keys, their grams, and the sums of the values of each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return (keys[at], [w[order[at]] for w in grams], *(np.add.reduceat(v[order], at) if len(at) else v for v in values))


def _stats(parts: list[tuple[bytes, bytes]], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys as contexts, and how often, and with how many words once, twice, or more."""
    keys = np.concatenate([_unplanes(k, width) for k, _ in parts])
    values = [np.concatenate([_unplanes(v[i * len(v) // 4 : (i + 1) * len(v) // 4], 8) for _, v in parts]).astype(np.int64) for i in range(4)]
    keys, *values = _summed(keys, *values)
    return keys, values


@dataclass(frozen=True)
class Model:
    files: Files
    layout: Layout
    tokens: int
    kinds: int
    bigrams: int
    #: Of single words, of pairs, and so on.
    discount: tuple[tuple[float, float, float], ...]
    word_left: float

    @property
    def order(self) -> int:
        return len(self.discount)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more; where counts of counts are missing, the discount is half the count's step."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def train(docs: DataFrame, *, order: int = 2, text: str = "text", where: Column | None = None) -> Model:
    """Count the grams of up to `order` words, 2 at least, of all texts (of the rows that where holds for).

    Null texts are empty: starts and an end.
    """
    if order < 2:
        raise ValueError("a model needs grams of two words or more")
    spark = docs.sparkSession
    ship(spark)
    layout = Layout(max(1, 2 * partitions(spark) // SPREAD) * SPREAD)
    files = Files(f"{qualified(spark, shared_dir(spark))}/lm-{uuid.uuid4().hex}")

    def count(batches):
        held, size = [], 0

        def flush():
            padded = np.concatenate(held)
            at = np.flatnonzero(padded != START)
            words64, c = np.unique(padded[at], return_counts=True)
            rows = [_row("word", "word", 1, o, _planes(words64[a:b], 8), _planes(c[a:b], 8)) for o, a, b in _split(layout.owner([words64 >> U(16)]), layout.owners)]
            padded >>= U(16)
            grams = [padded[at - order + 1 + j] for j in range(order)]
            del padded, at
            _, grams, c = _distinct(gram_key(grams), grams, np.ones(len(grams[0]), np.int64))
            return _rows(rows + _blocks(grams, c, layout), _FIELDS).to_batches()

        for batch in batches:
            for i, j in pieces(batch.column(0)):
                w = words(batch.column(0).slice(i, j - i), "space", lower=True)
                held.append(sequences(w.hashes(), w.first, order)[0])
                size += len(held[-1])
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def level(k: int):
        """Add up grams of k words, write them, and say what those of k - 1 need."""

        def add_up(key, table):
            part, o = key[0].as_py(), key[1].as_py()
            if part == "sum":
                return table
            if part == "word":
                keys, c = (np.concatenate([_unplanes(x, 8) for x in table.column(n).to_pylist()]) for n in ("keys", "counts"))
                keys, c = _summed(keys, c)
                return _rows([_row("word", "word", 1, o, _planes(keys, 8), _planes(c, 8))], _FIELDS)
            tok = table.filter(pc.equal(table.column("kind"), "tok"))
            as_ctx = table.filter(pc.equal(table.column("kind"), "ctx"))
            if tok.num_rows:
                grams = _grams(*(tok.column(n).to_pylist() for n in ("ctx", "runs", "keys")), k)
                c = np.concatenate([_unplanes(x, 8) for x in tok.column("counts").to_pylist()]).astype(np.int64)
            else:
                grams, c = [np.zeros(0, U)] * k, np.zeros(0, np.int64)
            del tok
            keys, grams, c = _distinct(gram_key(grams), grams, c)
            if k == order:
                files.put(f"gram{k}-{o}", _packed(keys, [c]))
            else:
                ctx_keys, stats = _stats(list(zip(as_ctx.column("keys").to_pylist(), as_ctx.column("counts").to_pylist(), strict=True)), 8) if as_ctx.num_rows else (np.zeros(0, U), [np.zeros(0, np.int64)] * 4)
                every = np.union1d(keys, ctx_keys)
                cols = np.zeros((5, len(every)), np.int64)  # different words before; total, n1, n2, n3 as a context
                cols[0, np.searchsorted(every, keys)] = c
                cols[1:, np.searchsorted(every, ctx_keys)] = stats
                files.put(f"gram{k}-{o}", _packed(every, list(cols)))
            rows = [_row("sum", "sum", k, o, sums=(*_counts_of_counts(c), len(c)))]
            ctx, first, *stats = _distinct(gram_key(grams[:-1]), grams[:-1], c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))
            owner = layout.owner(first)
            by = np.argsort(owner, kind="stable")
            sent, width = (ctx[by], 8) if k > 2 else (first[0][by], 6)
            for p, a, b in _split(owner[by], layout.owners):
                rows.append(_row("gram", "ctx", k - 1, p, _planes(sent[a:b], width), b"".join(_planes(x[by[a:b]], 8) for x in stats)))
            _, last, before = _distinct(gram_key(grams[1:]), grams[1:], np.ones(len(c), np.int64))
            return _rows(rows + _blocks(last, before, layout), _FIELDS)

        return add_up

    def finish(key, table):
        o = key[0].as_py()
        part = {k: [] for k in ("word", "ctx", "tok")}
        rows = []
        for kind, keys, values, *sums in zip(*(table.column(n).to_pylist() for n in ("kind", "keys", "counts", "level", "c1", "c2", "c3", "c4", "n")), strict=True):
            if kind == "sum":
                rows.append((*sums, 0, 0, 0))
            else:
                part[kind].append((keys, values))
        word, c = _summed(*(np.concatenate([_unplanes(x[i], 8) for x in part["word"]] or [np.zeros(0, U)]).astype(t) for i, t in ((0, U), (1, np.int64))))
        if any(int(START >> U(16)) in _unplanes(k, 6) for k, _ in part["ctx"]):
            word, c = _summed(np.append(word, START), np.append(c, 0))
        brief = word >> U(16)
        cols = np.zeros((5, len(word)), np.int64)  # total, n1, n2, n3 as a context; different words before
        found = [(slice(0, 4), *_stats(part["ctx"], 6))] if part["ctx"] else []
        if part["tok"]:
            keys, before = _summed(*(np.concatenate([_unplanes(x[i], w) for x in part["tok"]]) for i, w in ((0, 6), (1, 8))))
            found.append((slice(4, 5), keys, [before.astype(np.int64)]))
        for at, keys, values in found:
            k = np.minimum(np.searchsorted(keys, brief), len(keys) - 1)
            cols[at] = np.where(keys[k] == brief, np.array(values)[:, k], 0)
        cols[4][c == 0] = 0
        files.put(f"word-{o}", np.array([len(word)], np.int64).tobytes() + word.tobytes() + c.tobytes() + cols.tobytes())
        a = cols[4]
        rows.append((1, *_counts_of_counts(a), 0, int((a > 2).sum()), int(c.sum()), int((c > 0).sum())))
        return _rows(rows, _SUMS)

    used = docs if where is None else docs.where(where)
    sent = internal(used, text=text).mapInArrow(count, _FIELDS)
    for k in range(order, 1, -1):
        sent = sent.groupBy("part", "owner").applyInArrow(level(k), _FIELDS)
    sums = sent.groupBy("owner").applyInArrow(finish, _SUMS).groupBy("level")
    none = dict.fromkeys(("c1", "c2", "c3", "c4", "n", "more", "tokens", "kinds"), 0)
    total = {k: none for k in range(1, order + 1)} | {r.level: r.asDict() for r in sums.agg(*[F.sum(n).alias(n) for n in none]).collect()}
    d = tuple(discounts(*(total[k][f"c{i}"] for i in (1, 2, 3, 4))) for k in range(1, order + 1))
    one, bigrams = total[1], total[2]["n"]
    left = (d[0][0] * one["c1"] + d[0][1] * one["c2"] + d[0][2] * one["more"]) / bigrams if bigrams else 1.0
    return Model(files, layout, one["tokens"], one["kinds"], bigrams, d, left)


class Reader:
    """The arrays of a model, mapped when first used."""

    def __init__(self, model: Model):
        self.model, self._word, self._gram = model, {}, {}

    def word(self, o: int):
        if o not in self._word:
            m = self.model.files.map(f"word-{o}") if self._has(f"word-{o}") else None
            n = int(np.frombuffer(m, np.int64, 1)[0]) if m is not None else 0
            self._word[o] = (np.frombuffer(m, U, n, 8), np.frombuffer(m, np.int64, 6 * n, 8 + 8 * n).reshape(6, n)) if n else None
        return self._word[o]

    def gram(self, k: int, o: int):
        if (k, o) not in self._gram:
            name = f"gram{k}-{o}"
            t = _unpacked(self.model.files.map(name), 1 if k == self.model.order else 5) if self._has(name) else None
            self._gram[k, o] = t if t and len(t[0]) else None
        return self._gram[k, o]

    def _has(self, name: str) -> bool:
        return self.model.files.has(name)

    def words(self, keys: np.ndarray) -> np.ndarray:
        """For sorted words: count; total, n1, n2, n3 as a context; different words before."""
        out = np.zeros((6, len(keys)), np.int64)
        for o, a, b in _split(self.model.layout.owner([keys >> U(16)]), self.model.layout.owners):
            if (t := self.word(o)) is not None:
                k = np.minimum(np.searchsorted(t[0], keys[a:b]), len(t[0]) - 1)
                out[:, a:b] = np.where(t[0][k] == keys[a:b], t[1][:, k], 0)
        return out

    def grams(self, grams: list[np.ndarray], columns: range) -> np.ndarray:
        """Their count and, if they are shorter than the order, total, n1, n2, n3 as a context: the columns asked for."""
        k, key, owner = len(grams), gram_key(grams), self.model.layout.owner(grams).astype(np.int32)
        order = np.argsort(key)
        order = order[np.argsort(owner[order], kind="stable")]
        key, out = key[order], np.zeros((len(columns), len(key)), np.int64)
        for o, a, b in _split(owner[order], self.model.layout.owners):
            if (t := self.gram(k, o)) is not None:
                at = np.minimum(np.searchsorted(t[0], key[a:b]), len(t[0]) - 1)
                hit = t[0][at] == key[a:b]
                for i, column in enumerate(columns):
                    out[i, order[a:b][hit]] = _counts(t[1][column], at[hit])
        return out


def log_probabilities(reader: Reader, h: np.ndarray, first: np.ndarray):
    """For each token, ends included: log10 of its probability under the model, its count; and where texts begin."""
    m = reader.model
    padded, begin = sequences(h, first, m.order)
    at = np.flatnonzero(padded != START)
    kinds, which = np.unique(padded, return_inverse=True)
    info, w, v = reader.words(kinds), which[at], which[at - 1]
    p = (np.maximum(info[5] - _discount(info[5], m.discount[0]), 0) / max(m.bigrams, 1) + m.word_left / (m.kinds + 1))[w]
    brief = padded >> U(16)
    for k in range(2, m.order + 1):
        d, gram = m.discount[k - 1], [brief[at - k + 1 + j] for j in range(k)]
        c = reader.grams(gram, range(1))[0]
        total, *n = info[1:5, v] if k == 2 else reader.grams(gram[:-1], range(1, 5))
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(c > 0, np.maximum(c - _discount(c, d), 0) / total, 0.0)
            p = own + np.where(total > 0, (d[0] * n[0] + d[1] * n[1] + d[2] * n[2]) / total, 1.0) * p
    return np.log10(p), info[0][w], begin


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id", held_out: Callable[[object], bool] = lambda _: False) -> DataFrame:
    """One row for each text: tokens (words and an end), those known to the model, log10 probabilities of the whole text
    under add-one unigrams and under the model, perplexity by token.

    A null or empty text is an end alone; words never seen take the last class; with no training text all is unseen.
    Rows with a null id and repeated rows are scored like others. Other columns are left aside.
    """

    def scan(batches):
        reader = Reader(model)
        for batch in batches:
            for i, j in pieces(batch.column(1)):
                part = batch.slice(i, j - i)
                w = words(part.column(1), "space", lower=True)
                logs, c, begin = log_probabilities(reader, w.hashes(), w.first)
                n = np.diff(begin)
                s = np.add.reduceat(logs, begin[:-1])
                base = np.add.reduceat(np.log10((c + 1) / (model.tokens + model.kinds + 1)), begin[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([held_out(x) for x in part.column(0).to_pylist()], pa.bool_()), pa.array(n, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), begin[:-1])), pa.array(np.full(j - i, model.tokens)), pa.array(base), pa.array(s), pa.array(10 ** np.minimum(-s / n, 300))],
                    [x.split()[0] for x in _SCORE.split(", ")],
                )

    return internal(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _SCORE)
