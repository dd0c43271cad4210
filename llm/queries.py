"""The queries of this subpackage for the driver, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import chat as _chat, decontaminate as _decontaminate, exact as _exact, language as _language, licenses as _licenses, lm as _lm, mixture as _mixture, neardup as _neardup, secrets as _secrets, substring as _substring
from llm.cluster import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of the longest grams of op 1.
ORDER = 2


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    model = _lm.train(docs, order=ORDER, where=rest != 2)
    found = _lm.score(docs, model, held_out=lambda x: _lm.remainder(x) == 2)
    # six decimals: sums of doubles depend on their order beyond that
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return _chat.read_back(_chat.format_chats(told.unionByName(extra)))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neardup.near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=85)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _secrets.summary(_secrets.scan_secrets(docs, _secrets.train(docs)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no paths: a source is taken as a tree of folders of a thousand and a hundred documents, in each of
    # which the first document is the licence file
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 100").cast("string"), name)
    return _licenses.scan_licenses(table(spark, sf_dir, "documents"), path)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.copies(table(spark, sf_dir, "documents"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.summary(_decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring.summary(_substring.remove_repeats(table(spark, sf_dir, "documents"), n=13))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_chat_format, op3_minhash_neardup, op4_secret_scan, op5_license_scan, op6_exact_dedup, op7_mixture, op8_decontaminate, op9_language_id, op10_substring_dedup)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_SPACE = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"
_PLAIN = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_lm_scoring": rf"""
        WITH crc AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ),
        docs AS (
            SELECT doc_id, {_LOWER_SPACE} AS ws,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 2 AS held_out
            FROM documents, crc
        ),
        pairs AS (SELECT doc_id, held_out, unnest(list_prepend(' start', ws)) AS v, unnest(list_append(ws, ' end')) AS w FROM docs),
        uni AS (SELECT w, count(*) AS c FROM pairs WHERE NOT held_out GROUP BY w),
        bi AS (SELECT v, w, count(*) AS c FROM pairs WHERE NOT held_out GROUP BY v, w),
        ctx AS (SELECT v, sum(c) AS total, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c > 2) AS n3 FROM bi GROUP BY v),
        before AS (SELECT w, count(*) AS a FROM bi GROUP BY w),
        sums AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS kinds FROM uni),
        b AS (SELECT count(*) AS bigrams, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM bi),
        u AS (SELECT count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2, count(*) FILTER (a = 3) AS n3, count(*) FILTER (a = 4) AS n4, count(*) FILTER (a > 2) AS more FROM before),
        two AS (SELECT 'b' AS k, n1, n2, n3, n4 FROM b UNION ALL SELECT 'u', n1, n2, n3, n4 FROM u),
        raw AS (SELECT k, n1 / (n1 + 2 * n2) AS y, n1, n2, n3, n4 FROM two),
        d AS (
            SELECT k, least(greatest(1 - 2 * y * n2 / n1, 0), 1) AS d1, least(greatest(2 - 3 * y * n3 / n2, 0), 2) AS d2,
                   least(greatest(CASE WHEN n3 > 0 THEN 3 - 4 * y * n4 / n3 ELSE 2 - 3 * y * n3 / n2 END, 0), 3) AS d3
            FROM raw
        ),
        p1 AS (
            SELECT w, greatest(a - CASE WHEN a = 1 THEN d1 WHEN a = 2 THEN d2 ELSE d3 END, 0) / bigrams AS own
            FROM before, b, (SELECT * FROM d WHERE k = 'u')
        ),
        g1 AS (SELECT (d1 * n1 + d2 * n2 + d3 * more) / bigrams / (kinds + 1) AS g FROM (SELECT * FROM d WHERE k = 'u'), u, sums, (SELECT bigrams FROM b)),
        each AS (
            SELECT p.doc_id, p.held_out, coalesce(uni.c, 0) AS c,
                   CASE WHEN total IS NULL THEN coalesce(own, 0) + g
                        ELSE coalesce(greatest(bi.c - CASE WHEN bi.c = 1 THEN d1 WHEN bi.c = 2 THEN d2 ELSE d3 END, 0), 0) / total
                             + (d1 * ctx.n1 + d2 * ctx.n2 + d3 * ctx.n3) / total * (coalesce(own, 0) + g) END AS p
            FROM pairs p LEFT JOIN uni USING (w) LEFT JOIN bi ON bi.v = p.v AND bi.w = p.w LEFT JOIN ctx ON ctx.v = p.v LEFT JOIN p1 ON p1.w = p.w, (SELECT * FROM d WHERE k = 'b'), g1
        )
        SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens,
               round(sum(log10((c + 1) / (n + kinds + 1))), 6) AS base_score, round(sum(log10(p)), 6) AS score
        FROM each, sums GROUP BY doc_id, held_out
    """,
    "op2_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        sized AS (
            SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k, lead(role) OVER w AS next,
                   len(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|\[ROLE|\[/ROLE\]'))
                   + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 15 + len(role) END AS chars
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        ),
        judged AS (
            SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'assistant' OR before = 'system' THEN role = 'user'
                           WHEN before = 'user' THEN role = 'assistant' ELSE false END AND (next IS NOT NULL OR role IN ('user', 'assistant')) AS fine
            FROM sized
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(chars) AS BIGINT) AS formatted_chars, bool_and(fine) AS valid
        FROM judged GROUP BY conv_id
    """,
    "op3_minhash_neardup": rf"""
        WITH RECURSIVE docs AS (SELECT doc_id, {_LOWER_SPACE} AS ws FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM docs WHERE len(ws) > 0)
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
        ),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other)
        SELECT docs.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least AS component_id, docs.doc_id = least AS kept
        FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) USING (doc_id)
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_decontaminate": rf"""
        WITH items AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
        grams AS (
            SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS gram
            FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM items WHERE len(ws) > 0)
        ),
        docs AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
        places AS (
            SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS gram
            FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM grams) WHERE len(ws) >= size)
        ),
        found AS (SELECT doc_id, places.size, i, item_id FROM places JOIN grams ON places.size = grams.size AND places.gram = grams.gram),
        hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS w FROM found) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
        )
        SELECT docs.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op10_substring_dedup": rf"""
        WITH docs AS (SELECT doc_id, {_SPACE} AS ws FROM documents),
        places AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs WHERE len(ws) >= 13)
        ),
        found AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM places) WHERE least < doc_id),
        gone AS (SELECT doc_id, list(DISTINCT w) AS out FROM (SELECT doc_id, unnest(range(i, i + 13)) AS w FROM found) GROUP BY doc_id),
        kept AS (
            SELECT docs.doc_id, len(ws) AS n, coalesce(len(out), 0) AS n_removed,
                   CASE WHEN out IS NULL THEN ws ELSE list_select(ws, list_sort(list_filter(range(1, len(ws) + 1), lambda w: NOT list_contains(out, w)))) END AS ks
            FROM docs LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256
        FROM kept
    """,
}
