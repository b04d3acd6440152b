"""Repository reads, gates, averages, and the smaller text keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import numbers as N
from evidara.functions import periods as P
from evidara.functions import text as T
from evidara.operators import evaluation, facts, records, retrieval
from evidara.plans.fact_queries import FACTS
from evidara.plans.grounding_queries import key
from evidara.plans.registry import query
from evidara.plans.retrieval_queries import COS, EXPECT, RRF, TEXT_KEY, channels, judged
from evidara.sources import tables as S


@query(f"{RRF} SELECT query_id, key, v AS vector_rank, l AS lexical_rank FROM e")
def j4_ranks_side_by_side(spark, sf):
    return records.by_rank(channels(spark, sf))


@query(f"WITH {COS}, {EXPECT} SELECT v.query_id, v.vec_id AS doc_id, v.rank, s.doc_id IS NOT NULL AS hit FROM vtop v LEFT JOIN same s ON s.query_id = v.query_id AND s.doc_id = v.vec_id")
def j10_judged_hits(spark, sf):
    return judged(spark, sf)[0].select("query_id", "doc_id", "rank", F.coalesce(F.col("hit") == 1, F.lit(False)).alias("hit"))


@query(f"SELECT doc_id, doc_id || ':' || {TEXT_KEY} AS key FROM documents")
def d1_result_key(spark, sf):
    return S.documents(spark, sf).select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), T.content_hash("text")).alias("key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 100.0 WHEN o_orderkey % 3 = 0 THEN 80.0 WHEN o_orderkey % 3 = 1 THEN 50.0 ELSE 0.0 END AS f1 FROM orders")
def d8_set_overlap(spark, sf):
    """F1 of tools used and tools expected, repeats apart."""
    k, names = key(), lambda *x: F.array(*map(F.lit, x))
    used = F.when(k % 3 == 0, names("a", "b", "a")).when(k % 3 == 1, names("a")).otherwise(names("z"))
    want = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 3 == 0, names("a", "b", "c")).otherwise(names("a", "b", "c"))
    return S.read(spark, sf, "orders").select("o_orderkey", evaluation.set_f1(used, want).alias("f1"))


@query("SELECT doc_id, length(n) AS n_chars, sha256(n) AS digest FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents)".replace("\\\\", "\\"))
def x9_normal_content(spark, sf):
    n = T.normal("text")
    return S.documents(spark, sf).select("doc_id", F.length(n).cast("long").alias("n_chars"), F.sha2(n, 256).alias("digest"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 2 AS same FROM orders")
def p3_equivalent_periods(spark, sf):
    k = key()
    q = F.quarter("o_orderdate").cast("string")
    y = F.year("o_orderdate").cast("string")
    a = F.concat(F.lit("Q"), q, F.lit("_FY"), y)
    b = F.when(k % 3 == 0, F.concat(F.lit("q"), q, F.lit("-"), y)).when(k % 3 == 1, F.concat(F.lit(" Q"), q, F.lit("_"), y)).otherwise(F.concat(F.lit("Q"), q, F.lit("_"), (F.year("o_orderdate") + 1).cast("string")))
    return S.read(spark, sf, "orders").select("o_orderkey", (P.normal_period(a) == P.normal_period(b)).alias("same"))


@query("SELECT event_id, round(CASE event_type WHEN 'view' THEN 1 / (1 + greatest(value, 0)) WHEN 'click' THEN value END, 6) AS relevance FROM events")
def r7_vector_relevance(spark, sf):
    e = S.read(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "distance").when(F.col("event_type") == "click", "similarity").otherwise("other").alias("kind"), "value", F.lit(None).cast("double").alias("similarity"))
    return e.select("event_id", F.round(retrieval.relevance("kind", "value", "similarity"), 6).alias("relevance"))


@query("SELECT o_orderkey, CASE WHEN abs(v) >= 1e9 THEN printf('%.2f billion', round(v / 1e9, 2)) WHEN abs(v) >= 1e6 THEN printf('%.2f million', round(v / 1e6, 2)) ELSE printf('%.2f', round(v, 2)) END AS shown FROM (SELECT o_orderkey, CAST(o_orderkey * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10000 ELSE -10000000 END AS DOUBLE) AS v FROM orders)")
def n13_presented(spark, sf):
    k = key()
    return S.read(spark, sf, "orders").select("o_orderkey", N.presented(k * F.when(k % 3 == 0, 1).when(k % 3 == 1, 10_000).otherwise(-10_000_000)).alias("shown"))


@query(f"WITH {FACTS} SELECT company, fiscal_year, CAST(net_revenue + discounts - revenue AS DOUBLE) AS gap, abs(net_revenue + discounts - revenue) <= 1 AS balanced FROM w")
def a15_flow_audit(spark, sf):
    """Flows against their total, with a tolerance of one."""
    audited = facts.identity_audit(S.facts(spark, sf), "revenue", ["net_revenue", "discounts"], "1")
    return audited.withColumn("gap", (-F.col("gap")).cast("double"))


@query("SELECT count(*) AS documents, count(DISTINCT source) AS sources FROM documents")
def s17_count(spark, sf):
    return S.documents(spark, sf).agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))


@query("SELECT o_orderkey, concat_ws('/', strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S'), CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE (o_orderkey || '.5') END) AS cell FROM orders")
def s12_cell_value(spark, sf):
    """Dates in ISO form, numbers without a trailing zero."""
    v = key() + F.when(key() % 2 == 0, 0.0).otherwise(0.5)
    number = F.regexp_replace(v.cast("decimal(20,4)").cast("string"), r"\.?0+$", "")
    return S.read(spark, sf, "orders").select("o_orderkey", F.concat_ws("/", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), number).alias("cell"))


@query(f"WITH {FACTS} SELECT company, fiscal_year, metric, CAST(value AS DOUBLE) AS value FROM facts WHERE company IN (SELECT n_name FROM nation WHERE n_regionkey = 1) ORDER BY company, fiscal_year, metric")
def z2_find_by_owner(spark, sf):
    own = S.read(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("company"))
    return S.facts(spark, sf).join(own, "company", "left_semi").select("company", "fiscal_year", "metric", F.col("value").cast("double").alias("value")).orderBy("company", "fiscal_year", "metric")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE true END AS allowed FROM documents")
def z18_upload_moves(spark, sf):
    moves = {"CREATED": ["UPLOADING", "FAILED"], "UPLOADING": ["VERIFIED", "FAILED"], "VERIFIED": ["FINALIZED"]}
    k = F.col("doc_id") % 4
    now = F.when(k == 0, "CREATED").when(k == 1, "FINALIZED").when(k == 2, "VERIFIED").otherwise("FAILED")
    then = F.when(k == 0, "FAILED").when(k == 1, "CREATED").when(k == 2, "FINALIZED").otherwise("FAILED")
    return S.documents(spark, sf).select("doc_id", records.reachable(moves, now, then).alias("allowed"))


@query("SELECT count(*) AS cases, round(100 * avg(CASE WHEN doc_id % 3 <> 0 AND doc_id % 9 <> 4 THEN 1.0 ELSE 0 END), 4) AS scope, round(100 * avg(CASE WHEN doc_id % 9 <> 4 THEN 1.0 ELSE 0 END), 4) AS metric FROM documents")
def z22_agreement(spark, sf):
    k = F.col("doc_id")
    labels = S.documents(spark, sf).select(k.alias("case_id"), F.lit("a").alias("scope"), F.lit("m").alias("metric"))
    seen = labels.where("case_id % 9 <> 4").withColumn("scope", F.when(F.col("case_id") % 3 == 0, "b").otherwise("a"))
    return records.agreement(labels, seen, ["scope", "metric"])


@query("SELECT round(100 * avg(CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 2)::DOUBLE END), 1) AS candidate, round(100 * avg((doc_id % 3 = 0)::INT::DOUBLE), 1) AS rerank, count(*) FILTER (doc_id % 4 <> 0) AS candidate_cases, count(*) AS rerank_cases FROM documents")
def z24_stage_means(spark, sf):
    k = F.col("doc_id")
    rows = S.documents(spark, sf).select(F.when(k % 4 != 0, k % 2).alias("candidate"), (k % 3 == 0).cast("int").alias("rerank"))
    return records.stage_means(rows, ["candidate", "rerank"])


@query("SELECT doc_id, chunk FROM (SELECT doc_id, unnest(range(0, 3)) AS chunk FROM documents) WHERE (doc_id + chunk) % 4 <> 1")
def z30_eligible_pages(spark, sf):
    rows = S.documents(spark, sf).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("page"))
    pages = rows.withColumn("passed", (F.col("doc_id") + F.col("page")) % 4 != 1)
    return records.eligible_rows(rows, pages).select("doc_id", F.col("page").alias("chunk"))


@query("SELECT count(*) AS cases, count(*) FILTER (doc_id % 10 = 7 OR doc_id % 6 <> 0 AND doc_id % 50 = 1) AS regressions, count(*) FILTER (doc_id % 10 = 7 OR doc_id % 6 <> 0 AND doc_id % 50 = 1) = 0 AS promote FROM documents")
def z31_promotion(spark, sf):
    k = F.col("case_id")
    d = S.documents(spark, sf).select(F.col("doc_id").alias("case_id"))
    old = d.where(k % 10 != 7).withColumn("passed", k % 6 != 0)
    return records.promotion(old, d.withColumn("passed", ~((k % 6 == 0) | (k % 50 == 1))))


@query("SELECT source, count(*) AS documents, min(doc_id) AS first_id, list_aggregate(list_sort(list_distinct(list(lang))), 'string_agg', ',') AS langs FROM documents GROUP BY 1")
def z35_sources(spark, sf):
    return S.documents(spark, sf).groupBy("source").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT tenant_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM (SELECT CASE WHEN event_id % 10 <> 0 THEN user_id % 3 END AS tenant_id, CASE WHEN event_id % 4 = 0 THEN 1 ELSE CAST(floor(value) AS BIGINT) END AS quantity FROM events) WHERE tenant_id IS NOT NULL GROUP BY 1")
def y17_record_usage(spark, sf):
    u = S.usage(spark, sf).withColumn("tenant_id", F.when(F.col("event_id") % 10 != 0, F.col("tenant_id"))).withColumn("quantity", F.when(F.col("event_id") % 4 != 0, F.col("quantity")))
    return records.record_usage(u).groupBy("tenant_id").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("SELECT c_custkey AS tenant_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'pro' ELSE 'free' END AS plan, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 1000 ELSE 10 END AS requests FROM customer")
def y18_plan_of(spark, sf):
    t = S.read(spark, sf, "customer").select(F.col("c_custkey").alias("tenant_id"))
    s = t.where("tenant_id % 3 = 0").select("tenant_id", F.lit("pro").alias("plan"), (F.col("tenant_id") % 2 == 0).alias("active"))
    return records.plan_of(t, s, spark.createDataFrame([("free", 10), ("pro", 1000)], "plan string, requests int"))


@query("SELECT doc_id AS document_id, doc_id % 4 <> 0 AS ready, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS all_complete FROM documents")
def y19_ready(spark, sf):
    d = S.documents(spark, sf).select(F.col("doc_id").alias("document_id"))
    p = d.select("document_id", F.explode(F.array(*map(F.lit, ("parse", "index", "facts", "extra")))).alias("stage"))
    k, s = F.col("document_id"), F.col("stage")
    return records.ready(p.withColumn("complete", ~((k % 4 == 0) & (s == "facts") | (k % 5 == 0) & (s == "extra"))), ["parse", "index", "facts"])


@query("SELECT doc_id, quality = 1 AS quality, toxic <= 0.5 AS toxic, quality = 1 AND toxic <= 0.5 AS passed FROM labels")
def e14_gate(spark, sf):
    g = records.gate({"quality": F.col("quality") >= 1, "toxic": F.col("toxic") <= 0.5})
    return S.read(spark, sf, "labels").select("doc_id", g.alias("g")).select("doc_id", "g.*")


@query("SELECT o_orderkey, '{\"label\":\"' || o_orderstatus || '\",\"unit\":\"' || CASE WHEN o_orderkey % 2 = 0 THEN 'usd' ELSE '' END || '\",\"page\":\"' || o_orderkey % 7 || '\"}' AS row_json FROM orders")
def m3_row_json(spark, sf):
    """A typed row as scalars in JSON; what is missing is the empty text."""
    fields = {"label": F.col("o_orderstatus"), "unit": F.when(key() % 2 == 0, "usd"), "page": key() % 7}
    return S.read(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct(*(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in fields.items()))).alias("row_json"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'b,a' WHEN 1 THEN 'a' ELSE 'c,b,a' END AS once FROM orders")
def m7_ordered_distinct(spark, sf):
    names = lambda *x: F.array(*map(F.lit, x))
    a = F.when(key() % 3 == 0, names("b", "a", "b")).when(key() % 3 == 1, names("a", "a")).otherwise(names("c", "b", "c", "a", "b"))
    return S.read(spark, sf, "orders").select("o_orderkey", F.array_join(F.array_distinct(a), ",").alias("once"))
