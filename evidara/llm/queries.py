"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import bpe, filter_audit, fingerprints, html_extract, near_dup, packing, pii, quality, repeats, suffix_tree, token_counts, toxicity, whitening
from evidara.llm.common import table

#: The tokenizer file of the queries; operators take any path.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_BPE)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_quality counts, without the learnt verdict, so that SQL can say it."""
    docs = table(spark, sf_dir, "documents")
    nothing = np.zeros(1 << quality.MODEL.bits, np.float32)
    return quality.judge(docs, (nothing, 1.0, 0.0), "doc_id").select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans of each kind op4_pii finds, without what it learns from them, so that SQL can say it."""
    return pii.count_base(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_lm_scoring, op3_bpe, op4_pii, op5_near_dup, op6_packing, op7_token_counts, op8_quality, op9_html, op10_fingerprints, op11_filter_audit, op12_substring_dedup, op13_whitening)}
QUERIES |= {"corpus_base_counts": base_counts, "corpus_base_spans": base_spans}

WORDS = r"regexp_extract_all({0}, '[^ \t\n\x0B\f\r]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: All pairs of documents that share a shingle, then what is reachable by links: exact, for tables of a few thousand documents.
NEAR = f"""WITH RECURSIVE t AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, b FROM r JOIN both_ways ON r.o = a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN (SELECT doc_id, min(o) AS component_id FROM r GROUP BY 1) USING (doc_id)"""
COUNTS = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM x) WHERE n > 1),
m AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM h) GROUP BY 1),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda y: len({WORDS.format("y")}) > 0) AS lines FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(m.n, 0) > 30 * n_words AS base_failed FROM c LEFT JOIN m USING (doc_id)"""
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
LUHN = "list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i:i] AS INTEGER) ELSE CAST(d[i:i] AS INTEGER) * 2 - CASE WHEN CAST(d[i:i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
SPANS = rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len(list_filter(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda v: list_max(list_transform(string_split(v, '.'), lambda x: coalesce(TRY_CAST(x AS BIGINT), 999))) <= 255)) AS BIGINT) AS n_ip,
CAST(len(list_filter(list_transform(regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+'), lambda v: {DIGITS}), lambda d: length(d) BETWEEN 14 AND 19 AND {LUHN})) AS BIGINT) AS n_card,
CAST(len(list_filter(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda v: length({DIGITS}) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""
#: What every filter does after every set of filters applied before it, document by document, for each order written out.
AUDIT = rf"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT w.*, min(doc_id) OVER (PARTITION BY text) AS first_id FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
d AS MATERIALIZED (SELECT part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM t LEFT JOIN l USING (doc_id)),
c AS MATERIALIZED (SELECT part, fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT '' AS o UNION ALL SELECT o || f FROM o, f WHERE NOT contains(o, f)),
s AS (SELECT o AS filter_order, CAST(k AS INTEGER) AS step, o[1:k - 1] AS before, o[k:k] AS f FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS k FROM o WHERE length(o) = 5)),
x AS (SELECT part, filter_order, step, f, n, good, toxic, fails, fails <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone, contains(fails, f) AS failing FROM c, s),
r AS MATERIALIZED (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND failing AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
#: All windows of all documents, spelled out.
REPEATS = f"""WITH t AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM k) WHERE doc_id > lo),
u AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t) ANTI JOIN r USING (doc_id, i)),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM u GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.text, '')) AS kept_sha256 FROM t LEFT JOIN s USING (doc_id)"""
ORACLES: dict[str, str] = {"op5_near_dup": NEAR, "op11_filter_audit": AUDIT, "op12_substring_dedup": REPEATS, "corpus_base_counts": COUNTS, "corpus_base_spans": SPANS}
