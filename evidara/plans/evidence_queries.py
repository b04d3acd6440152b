"""Chunks of blocks, evidence checks, citations and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import chunking, evaluation
from evidara.plans.registry import query
from evidara.sources import tables as S

#: Sentences packed by a fold in SQL: pieces are parted by a mark that no text holds.
SPLIT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(s)), lambda s: s <> '')"
PACK = "list_reduce(s, lambda a, x: CASE WHEN length(split_part(a, chr(31), -1)) + 1 + length(x) > 300 THEN a || chr(31) || trim(ltrim(right(split_part(a, chr(31), -1), 40)) || ' ' || x) ELSE a || ' ' || x END)"


@query(rf"WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents WHERE length(text) < 4000), s AS (SELECT doc_id, text, {SPLIT} AS s FROM d), p AS (SELECT doc_id, s, CASE WHEN length(text) <= 300 THEN [text] ELSE string_split({PACK}, chr(31)) END AS pieces FROM s WHERE length(text) <= 300 OR len(s) > 1 AND list_max(list_transform(s, lambda x: length(x))) <= 300) SELECT doc_id, len(pieces) AS n, sha256(array_to_string(pieces, '|')) AS digest FROM p")
def x3_sentences(spark, sf):
    """Sentence packing of the documents under 4000 characters whose sentences all fit (the others go by windows, see x3_chunks)."""
    d = S.documents(spark, sf).where(F.length("text") < 4000).select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    parts = F.filter(F.transform(F.split("text", chunking.SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")
    fits = (F.length("text") <= 300) | (F.size(parts) > 1) & F.forall(parts, lambda s: F.length(s) <= 300)
    p = d.where(fits).select("doc_id", chunking.sentence_pieces(F.col("text"), 300, 40).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.sha2(F.array_join("p", "|"), 256).alias("digest"))


def order_blocks(spark, sf):
    """The lines of an order as blocks: a customer's order is a document, its ship year the page."""
    l = S.read(spark, sf, "lineitem")
    kind = F.when(F.col("l_linenumber") % 4 == 0, "unverified_table").when(F.col("l_linenumber") % 2 == 0, "table").otherwise("text")
    return l.select(F.col("l_orderkey").alias("doc_id"), F.year("l_shipdate").alias("page"), F.col("l_linenumber").alias("place"), F.concat_ws(" ", "l_returnflag", "l_linestatus", F.repeat(F.lit("x"), (F.col("l_linenumber") * 7).cast("int"))).alias("text"), kind.alias("kind"))


CHUNKED = """WITH b AS (SELECT l_orderkey AS doc_id, year(l_shipdate) AS page, l_linenumber AS place, l_returnflag || ' ' || l_linestatus || ' ' || repeat('x', CAST(l_linenumber * 7 AS INTEGER)) AS text, CASE WHEN l_linenumber % 4 = 0 THEN 'u' WHEN l_linenumber % 2 = 0 THEN 't' ELSE 'n' END AS kind FROM lineitem),
p AS (SELECT doc_id, page, list(kind || chr(31) || text ORDER BY place, text) AS b FROM b GROUP BY 1, 2),
f AS (SELECT doc_id, page, list_reduce(b, lambda a, x: CASE WHEN length(list_aggregate(list_transform(string_split(split_part(a, chr(29), -1), chr(30)), lambda y: split_part(y, chr(31), 2)), 'string_agg', chr(10) || chr(10))) + 2 + length(split_part(x, chr(31), 2)) > 60 OR x[1] = 't' AND contains(split_part(a, chr(29), -1), 'u' || chr(31)) OR x[1] = 'u' AND contains(split_part(a, chr(29), -1), 't' || chr(31)) THEN a || chr(29) || x ELSE a || chr(30) || x END) AS packed FROM p),
c AS (SELECT doc_id, page, unnest(string_split(packed, chr(29))) AS g, generate_subscripts(string_split(packed, chr(29)), 1) - 1 AS chunk FROM f),
k AS (SELECT *, string_split(g, chr(30)) AS parts, list_distinct(list_transform(string_split(g, chr(30)), lambda y: y[1])) AS kinds FROM c)
SELECT doc_id, page, CAST(chunk AS INTEGER) AS chunk, array_to_string(list_transform(parts, lambda y: split_part(y, chr(31), 2)), chr(10) || chr(10)) AS text, CASE WHEN list_contains(kinds, 'u') THEN 'unverified_table' WHEN len(kinds) > 1 THEN 'mixed' WHEN kinds[1] = 't' THEN 'table' ELSE 'text' END AS content_type FROM k"""


@query(CHUNKED)
def x5_chunk_pages(spark, sf):
    return chunking.chunk_pages(order_blocks(spark, sf), 60)


@query("SELECT l_orderkey, CAST(sum(length(l_returnflag || ' ' || l_linestatus || ' ' || repeat('x', CAST(l_linenumber * 7 AS INTEGER)))) + 2 * (count(*) - 1) AS INTEGER) AS chars FROM lineitem GROUP BY 1")
def x8_joined_length(spark, sf):
    g = order_blocks(spark, sf).groupBy(F.col("doc_id").alias("l_orderkey")).agg(F.collect_list(F.struct("text", "kind")).alias("b"))
    return g.select("l_orderkey", chunking.joined_length(F.col("b")).alias("chars"))


@query("SELECT o_orderkey, o_orderstatus || chr(10) || chr(10) || 'Two  words' || CASE WHEN lower(o_orderpriority) = 'two words' OR o_orderkey % 3 = 0 THEN '' ELSE chr(10) || chr(10) || o_orderpriority END AS text FROM orders")
def d10_merged_paragraphs(spark, sf):
    o = S.read(spark, sf, "orders")
    second = F.concat(F.lit("two WORDS\n\n \n\n"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")))
    return o.select("o_orderkey", chunking.merged_paragraphs(F.concat("o_orderstatus", F.lit("\n\nTwo  words ")), second).alias("text"))


@query("SELECT conv_id, turn, greatest(0.0, least(100.0, 100.0 - 10 * ((contains(t, 'risk-free'))::INT + (contains(t, 'guaranteed return'))::INT + (contains(t, 'secret deal'))::INT) + CASE WHEN turn % 2 = 0 THEN 5 ELSE 0 END)) AS score FROM (SELECT conv_id, turn, lower(text || CASE turn % 4 WHEN 1 THEN ' a RISK-FREE guaranteed return' WHEN 2 THEN ' a secret deal' ELSE '' END) AS t FROM conversations WHERE text IS NOT NULL)")
def e4_hallucination(spark, sf):
    t = F.concat("text", F.when(F.col("turn") % 4 == 1, " a RISK-FREE guaranteed return").when(F.col("turn") % 4 == 2, " a secret deal").otherwise(""))
    sources = F.when(F.col("turn") % 2 == 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
    return S.messages(spark, sf).where("text IS NOT NULL").select("conv_id", "turn", evaluation.hallucination(t, sources, F.array().cast("array<string>")).alias("score"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 100.0 WHEN doc_id % 7 = 0 THEN 0.0 WHEN lang = 'en' THEN 100.0 ELSE 0.0 END AS score FROM documents")
def e6_categorical_match(spark, sf):
    actual, expected = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit(" "), F.upper("lang"))), F.when(F.col("doc_id") % 5 != 0, "en")
    return S.documents(spark, sf).select("doc_id", evaluation.categorical_match(actual, expected).alias("score"))


@query("WITH g AS (SELECT conv_id, list_distinct(list(lower(role))) AS r FROM conversations GROUP BY 1), m AS (SELECT conv_id, r, CASE conv_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['user'] ELSE ['user', 'system'] END AS e FROM g) SELECT conv_id, CASE WHEN len(e) = 0 THEN NULL ELSE round(200.0 * len(list_intersect(r, e)) / (len(r) + len(e)), 1) END AS score FROM m")
def e7_citation_source_match(spark, sf):
    g = S.messages(spark, sf).groupBy("conv_id").agg(F.collect_list(F.upper("role")).alias("r"))
    want = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(" "))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("User "))).otherwise(F.array(F.lit("user"), F.lit("SYSTEM"), F.lit("system")))
    return g.select("conv_id", evaluation.source_match(F.col("r"), want).alias("score"))


@query("SELECT CASE WHEN ta AND NOT tb THEN 'HYBRID' WHEN tb AND NOT ta THEN 'TREE' WHEN ra > rb OR ra = rb AND pa > pb THEN 'HYBRID' WHEN ra < rb OR ra = rb AND pa < pb THEN 'TREE' ELSE 'TIE' END AS winner, count(*) AS cases FROM (SELECT doc_id % 4 <> 0 AS ta, doc_id % 6 <> 0 AS tb, doc_id % 5 AS ra, doc_id % 3 AS rb, doc_id % 2 AS pa, doc_id % 7 AS pb FROM documents) GROUP BY 1")
def e9_compare_retrievers(spark, sf):
    k = F.col("doc_id")
    a = F.struct(F.array((k % 4 == 0).cast("int"), F.lit(0)).alias("wrong"), (k % 5).alias("recall"), (k % 2).alias("precision"))
    b = F.struct(F.array(F.lit(0), (k % 6 == 0).cast("int")).alias("wrong"), (k % 3).alias("recall"), (k % 7).alias("precision"))
    return S.documents(spark, sf).select(evaluation.better_retriever(a, b).alias("winner")).groupBy("winner").agg(F.count("*").alias("cases"))


@query("SELECT string_agg('[Evidence ' || rank || ']' || chr(10) || 'Source: ' || source || chr(10) || 'Chunk: ' || doc_id || chr(10) || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context, lang FROM (SELECT lang, source, doc_id, substr(text, 1, 80) AS text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5 GROUP BY lang")
def x27_context(spark, sf):
    e = S.documents(spark, sf).select("lang", "source", F.col("doc_id").alias("chunk_id"), F.substring("text", 1, 80).alias("text"), F.col("doc_id").alias("place"))
    return evaluation.context(e, "lang", 5)


@query("SELECT lang, string_agg('[Evidence ' || rank || ']' || chr(10) || 'Source: ' || source || chr(10) || 'Chunk: ' || doc_id || chr(10) || 'Confidence: 0.5' || chr(10) || chr(10) || 'Preview:' || chr(10) || substr(text, 1, 150) || chr(10) || chr(10) || repeat('-', 60), chr(10) ORDER BY rank) AS citations FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3 GROUP BY lang")
def y4_citations(spark, sf):
    e = S.documents(spark, sf).select("lang", "source", F.col("doc_id").alias("chunk_id"), "text", F.lit("0.5").alias("confidence"), F.col("doc_id").alias("place"))
    return evaluation.citations(e, "lang", 3)


@query("SELECT d.doc_id, (d.doc_id % 3 <> 1) AS held FROM documents d WHERE length(d.text) > 60")
def j5_source_spans(spark, sf):
    """Evidence stands if its document, its page and its words are those of a source span; here each third has other words."""
    d = S.documents(spark, sf).where(F.length("text") > 60)
    sources = d.select("doc_id", F.lit(1).alias("block_id"), (F.col("doc_id") % 9).alias("page"), "text")
    words = F.when(F.col("doc_id") % 3 == 1, F.lit("no such words are there ☃")).otherwise(F.substring("text", 11, 40))
    evidence = d.select("doc_id", F.lit(1).alias("block_id"), (F.col("doc_id") % 9).alias("page"), words.alias("words"))
    return evaluation.held_by_source(evidence, sources).select("doc_id", "held")


@query("SELECT company, CASE WHEN bool_and(there) THEN 'FULL' WHEN bool_or(there) THEN 'PARTIAL' ELSE 'NONE' END AS coverage, round(avg(CASE WHEN there THEN 1.0 ELSE 0 END), 6) AS share FROM (SELECT n_name AS company, n_nationkey % 3 = 0 OR n_nationkey % 3 = 1 AND y % 2 = 0 AS there FROM nation, range(1993, 1997) t(y)) GROUP BY 1")
def a25_coverage(spark, sf):
    n = S.read(spark, sf, "nation")
    required = n.select(F.col("n_name").alias("company"), F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(1993), F.lit(1996))).alias("fiscal_year"))
    found = required.where("k % 3 = 0 OR k % 3 = 1 AND fiscal_year % 2 = 0").select("company", "fiscal_year")
    return evaluation.coverage(required.select("company", "fiscal_year"), found, "company", ["fiscal_year"])


@query("SELECT status, n, scored, quality, CAST(latency AS DOUBLE) AS latency FROM (SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'running' ELSE 'success' END AS status, count(*) AS n, count(*) FILTER (event_type <> 'view') AS scored, round(avg(CASE WHEN event_type <> 'view' THEN value END), 4) AS quality, round(avg(CASE WHEN event_type <> 'view' THEN value * 10 END), 4) AS latency FROM events GROUP BY 1)")
def a13_benchmark_summary(spark, sf):
    t = S.traces(spark, sf).withColumn("quality", F.when(F.col("status") != "running", F.col("value")))
    return evaluation.benchmark_summary(t, "status", "quality", "duration_ms")


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(lang || ', ' || source || '| ,' || lang, ',', '|'), '|'), lambda x: trim(x)), lambda x: x <> ''), '/') AS parts, array_to_string([lang, source], '/') AS once FROM documents")
def m4_listed(spark, sf):
    """Values parted by pipes or commas, and each once in order (also M7)."""
    parts = T.listed(F.concat("lang", F.lit(", "), "source", F.lit("| ,"), "lang"))
    return S.documents(spark, sf).select("doc_id", F.array_join(parts, "/").alias("parts"), F.array_join(F.array_distinct(parts), "/").alias("once"))


@query("SELECT CASE WHEN doc_id % 4 = 0 THEN 'filing' WHEN doc_id % 3 = 0 THEN 'public' ELSE 'private' END AS authority, count(*) AS n FROM documents GROUP BY 1")
def z36_source_authority(spark, sf):
    named = F.when(F.col("doc_id") % 4 == 0, " Filing ").when(F.col("doc_id") % 4 == 1, "")
    return S.documents(spark, sf).select(T.authority(named, F.col("tenant_id")).alias("authority")).groupBy("authority").agg(F.count("*").alias("n"))


@query("SELECT query_id, doc_id, confidence, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id % 50 AS query_id, doc_id, length(text) / 1000.0 - 0.5 AS score, round(greatest(0, least(1, length(text) / 1000.0 - 0.5)), 4) AS confidence FROM documents)")
def r23_confidence(spark, sf):
    d = S.documents(spark, sf).select((F.col("doc_id") % 50).alias("query_id"), "doc_id", (F.length("text") / 1000.0 - 0.5).alias("score"))
    return evaluation.ranked_confidence(d)


@query("SELECT query_id, doc_id FROM (SELECT doc_id % 50 AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY length(text) DESC, doc_id) AS r, bool_or(doc_id % 400 < 100) OVER (PARTITION BY doc_id % 50) AS admitted FROM documents) WHERE r = 1 AND NOT admitted")
def r22_best_rejected(spark, sf):
    """Where nothing was admitted for a query, its most confident rejected row (the first of equals)."""
    d = S.documents(spark, sf).select((F.col("doc_id") % 50).alias("query_id"), "doc_id", F.length("text").alias("confidence"), (F.col("doc_id") % 400 < 100).alias("admitted"))
    return evaluation.best_rejected(d).select("query_id", "doc_id")
