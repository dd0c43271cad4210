"""Language identification by Bayesian fusion of evidence.

For each language the log posterior is the sum of
- the text's log likelihood under byte trigrams of letters, counted over all labelled documents and smoothed; neighbouring
  trigrams say the same thing again, so the mean counts as at most EFFECTIVE independent ones,
- the log probability of the declared markup language and of the address suffix given the language, estimated from how
  often each goes with the language that the text alone suggests,
- the log prior of the host, smoothed towards its domain's, that one towards the prior of all; a row's own vote is left
  out of its host's counts.
One more class, und, has all trigrams equally likely: texts that look like no language, or have no letters, go there.
All counts are grouped aggregations; tables that tasks get have a size fixed by the labels and BUCKETS.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from llm.cluster import ROW, internal, join_hot, keyed, saved, ship, without
from llm.text import PIECE, _buffers, _LOWER, pieces

BUCKETS = 1 << 15
EFFECTIVE = 60.0
#: Added to counts of trigrams, of declared languages and suffixes; weight of a domain's prior and of the prior of all.
SMOOTH, EVIDENCE, DOMAIN, GLOBAL = 0.5, 1.0, 5.0, 5.0
UND = "und"
#: Labels that a training table may have.
MOST_LABELS = 500
#: Country suffixes that speak for a language; a fixed table.
SUFFIX = {"de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}

_LETTER = _LOWER.copy()
_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts that hold a letter, and where each text's begin."""
    raw, off = _buffers(texts)
    x = _LETTER[raw].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    code = ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64)
    ok = (x[1:-1] != 0x20) & ~((x[:-2] == 0x20) & (x[2:] == 0x20))
    for e in off[1:-1]:  # no trigram reaches over the edge of a text
        ok[max(0, e - 2) : e] = False
    at = np.flatnonzero(ok)
    return code[at], np.searchsorted(at, off)


@dataclass(frozen=True)
class TextModel:
    labels: tuple[str, ...]
    table: np.ndarray  # buckets x (labels and und)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code, first = grams(texts)
        n = np.diff(first)
        total = np.zeros((len(n), self.table.shape[1]))
        full = np.flatnonzero(n)
        if len(full):
            got = self.table[code]
            total[full] = np.add.reduceat(got, first[full], axis=0)
        return total * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None], n


def text_model(docs: DataFrame, *, text: str = "text", label: str = "lang") -> TextModel:
    """Counted over all labelled texts; rows without a label or text are left aside."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, j in pieces(batch.column(1), PIECE // 2):
                part = batch.slice(i, j - i)
                code, first = grams(part.column(1))
                for name in set(part.column(0).to_pylist()):
                    own = np.repeat([x == name for x in part.column(0).to_pylist()], np.diff(first))
                    held[name] = held.get(name, 0) + np.bincount(code[own], minlength=BUCKETS)
        for name, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["label", "bucket", "n"])

    ship(docs.sparkSession)
    known = internal(docs, label=label, text=text).where("label is not null and text is not null")
    sums = known.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    names = [r.label for r in known.select("label").distinct().orderBy("label").limit(MOST_LABELS + 1).collect()]
    if len(names) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages")
    table = np.zeros((BUCKETS, len(names) + 1))
    for r in sums.coalesce(1).toLocalIterator():  # BUCKETS times labels at most
        table[r.bucket, names.index(r.label)] = r.n
    table += SMOOTH
    table[:, -1] = 1.0
    return TextModel(tuple(names), np.log(table / table.sum(axis=0)).astype(np.float32))


def page_fields(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, text without markup, declared language, suffix (of the host, else a first path part of two letters), host, domain."""
    p = internal(pages, id=page_id, url=url, html=html)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    tld, path = F.regexp_extract("host", r"\.([a-z]{2})$", 1), F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/]*/([a-z]{2})(?:[/?#]|$)", 1)
    named = F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv])
    return p.withColumn("host", host).select(
        F.col("id").cast("long").alias("id"),
        F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ").alias("text"),
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)).alias("declared"),
        F.coalesce(F.try_element_at(named, tld), path).alias("suffix"),
        "host", F.regexp_extract("host", r"([^.]*\.[^.]*)$|^([^.]*)$", 0).alias("domain"),
    )


def _code(col: str, labels: tuple[str, ...]) -> Column:
    """A label's number; after them, something else, and nothing said."""
    c = F.when(F.col(col).isNull() | (F.col(col) == ""), len(labels) + 1)
    for i, name in enumerate(labels):
        c = c.when(F.col(col) == name, i)
    return c.otherwise(len(labels)).cast("int")


def _array(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def fuse(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows: id, text, declared, suffix, host, domain -> id, text_lang, lang, confidence; und where no language fits."""
    ship(rows.sparkSession)
    k = len(model.labels) + 1
    names = [*model.labels, UND]

    def scan(batches):
        for batch in batches:
            for i, j in pieces(batch.column(1), PIECE // 2):
                part = batch.slice(i, j - i)
                s, n = model.scores(part.column(1))
                best = np.where(n > 0, s.argmax(axis=1), k - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), *[part.column(c) for c in range(2, 6)], pa.array(best), pa.array(n.astype(np.int64)), pa.array(s.tolist(), pa.list_(pa.float64()))], ["id", "declared", "suffix", "host", "domain", "best", "grams", "ll"])

    coded = rows.select(F.col("id").cast("long").alias("id"), "text", _code("declared", model.labels).alias("declared"), _code("suffix", model.labels).alias("suffix"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("domain", F.lit("")).alias("domain"))
    scored = saved(coded.mapInArrow(scan, "id long, declared int, suffix int, host string, domain string, best int, grams long, ll array<double>"), "scored")
    says = {}
    for what in ("declared", "suffix"):
        c = np.zeros((k, k + 1))
        for r in scored.groupBy("best", what).count().collect():
            c[r[0], r[1]] = r[2]
        c += EVIDENCE
        says[what] = np.log(c / c.sum(axis=1, keepdims=True)).T
    votes = scored.groupBy("domain", "host").agg(F.count(F.lit(1)).alias("rows"), *[F.sum((F.col("best") == i).cast("long")).alias(f"n{i}") for i in range(k)])
    votes = saved(votes, "votes")
    of_domain = votes.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(k)])
    every = votes.agg(F.coalesce(F.sum("rows"), F.lit(0)), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(k)]).first()
    prior = (np.array(every[1:], float) + 1) / (every[0] + k)
    counts = votes.join(of_domain, "domain").select(F.struct("domain", "host").alias("key"), "rows", F.array(*[F.col(f"n{i}").cast("double") for i in range(k)]).alias("own"), F.array(*[F.col(f"d{i}").cast("double") for i in range(k)]).alias("wide"))
    both = join_hot(scored.withColumn("key", F.struct("domain", "host")), counts, "key", "rows", every[0])
    one = lambda i: (F.col("best") == i).cast("double")
    g = _array(prior)
    wide = F.aggregate("wide", F.lit(0.0), lambda a, x: a + x) - 1

    def posterior(i):
        domain = (F.get("wide", i) - one(i) + GLOBAL * F.get(g, i)) / (wide + GLOBAL)
        host = (F.get("own", i) - one(i) + DOMAIN * domain) / (F.col("rows") - 1 + DOMAIN)
        said = sum(F.get(_array(says[w].ravel()), F.col(w) * k + i) for w in ("declared", "suffix"))
        return F.get("ll", i) + F.log(host) + said

    done = both.withColumn("post", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), posterior))
    top = F.array_max("post")
    name = F.array(*map(F.lit, names))
    # without a single letter there is no text evidence for any language
    lang = F.when(F.col("grams") == 0, F.lit(UND)).otherwise(F.get(name, (F.array_position("post", top) - 1).cast("int")))
    sure = 1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return done.select("id", F.get(name, F.col("best")).alias("text_lang"), lang.alias("lang"), F.when(F.col("grams") == 0, 1.0).otherwise(sure).alias("confidence"))


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row for each page: page_id, text_lang (by the text alone), lang, confidence.

    Null or empty pages and those without letters are und; a null address is a host of its own; ties go to the label first
    in code point order; null ids and repeated rows are pages of their own. Other columns are left aside. An empty table
    gives an empty result; without labelled texts all is und.
    """
    return fuse(page_fields(pages), text_model(labelled)).withColumnRenamed("id", "page_id")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents that some language fits, all their columns as they are; their source stands for the host.

    Each row is judged by itself, whether its id is null or repeated.
    """
    docs = keyed(docs)
    rows = internal(docs, id=ROW, text="text", host="source").select("id", "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), "host", F.lit("").alias("domain"))
    bad = fuse(rows, text_model(docs)).where(F.col("lang") == UND).select(F.col("id").alias(ROW))
    return without(docs, saved(bad, "rejected"), ROW).drop(ROW)
