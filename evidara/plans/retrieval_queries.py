"""Retrieval, fusion and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import corpus, evaluation, retrieval
from evidara.plans.registry import query
from evidara.sources import tables as S

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
BM25 = rf"""tok AS (SELECT doc_id, unnest({WORDS.format("text")}) AS term FROM documents),
len AS (SELECT doc_id, CAST(len({WORDS.format("text")}) AS DOUBLE) AS length FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
size AS MATERIALIZED (SELECT count(*) AS documents, avg(length) AS mean_length FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS MATERIALIZED (SELECT term, df, ln(documents - df + 0.5) - ln(df + 0.5) AS raw FROM df, size),
mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mean),
q AS (SELECT item_id AS query_id, unnest({WORDS.format("text")}) AS term FROM benchmark),
qtf AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY 1, 2),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM qtf JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (doc_id), size GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored) WHERE rank <= 20)"""
COS = """qv AS (SELECT vec_id // 100 AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
cosine AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS score FROM embeddings, qv),
vtop AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM cosine) WHERE rank <= 20)"""


def asked(spark, sf):
    """Every benchmark passage as a query."""
    return S.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_queries(spark, sf):
    """Every vector whose id is divisible by 100 as a query, numbered from 0."""
    return S.read(spark, sf, "embeddings").where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("query_id"), F.col("embedding").alias("query_vector"))


def lexical(spark, sf):
    return retrieval.bm25(S.documents(spark, sf), asked(spark, sf), 20)


def by_vector(spark, sf):
    return retrieval.vector_top(S.read(spark, sf, "embeddings"), vector_queries(spark, sf), 20)


@query(f"WITH {BM25} SELECT query_id, rank, doc_id, score FROM bm25")
def r1_bm25(spark, sf):
    return lexical(spark, sf)


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def a21_document_frequency(spark, sf):
    return retrieval.inverse_frequency(S.documents(spark, sf)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {COS} SELECT query_id, rank, vec_id, score, round(1 - score, 6) AS distance FROM vtop")
def r3_vector_top(spark, sf):
    return by_vector(spark, sf)


@query("SELECT doc_id, source FROM documents WHERE (doc_id % 3 = 1 OR doc_id % 3 = 0) AND lang = 'en'")
def f3_tenant_scope(spark, sf):
    d = S.documents(spark, sf).where(retrieval.in_scope(F.col("tenant_id"), F.lit(1), include_public=True))
    return retrieval.apply_filters(d, lang="en").select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND source = 'src1'")
def f1_filters(spark, sf):
    return retrieval.apply_filters(S.documents(spark, sf), [1, 2, 3, 5, 8, 13, 21, 34], "src1").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR text NOT LIKE '% | %'")
def f6_quarantine(spark, sf):
    kind = F.when(F.col("doc_id") % 5 == 0, None).when(F.contains(F.col("text"), F.lit(" | ")), "Unverified_Table").otherwise("narrative")
    return retrieval.verified(S.documents(spark, sf).withColumn("content_type", kind)).select("doc_id")


@query("WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'distance' WHEN 'click' THEN 'similarity' WHEN 'error' THEN 'relevance' ELSE 'bm25' END AS sem, value FROM events), v AS (SELECT event_id, CASE sem WHEN 'distance' THEN 1 / (1 + greatest(value, 0)) WHEN 'similarity' THEN value WHEN 'relevance' THEN value END AS rel FROM r) SELECT event_id, round(rel, 6) AS relevance, CAST(row_number() OVER (ORDER BY rel DESC NULLS LAST, event_id) AS INTEGER) AS rank FROM v ORDER BY rel DESC NULLS LAST, event_id LIMIT 200")
def r6_global_ranking(spark, sf):
    kind = F.when(F.col("event_type") == "view", "distance").when(F.col("event_type") == "click", "similarity").when(F.col("event_type") == "error", "relevance").otherwise("bm25")
    e = S.read(spark, sf, "events").select(F.lit(0).alias("query_id"), "event_id", kind.alias("kind"), "value", F.lit(None).cast("double").alias("similarity"))
    ranked = e.withColumn("relevance", retrieval.relevance("kind", "value", "similarity"))
    return retrieval.top(ranked, 200, [F.col("relevance").desc_nulls_last(), F.col("event_id")]).select("event_id", F.round("relevance", 6).alias("relevance"), "rank")


def channels(spark, sf, near=None):
    """Both rankings under one query number, keyed by document or vector number. near: by_vector, if it is at hand."""
    l = lexical(spark, sf).select("query_id", F.col("doc_id").alias("key"), F.lit("lexical").alias("channel"), "rank", F.lit(1.25).cast("double").alias("weight"))
    v = (near or by_vector(spark, sf)).select("query_id", F.col("vec_id").alias("key"), F.lit("vector").alias("channel"), "rank", F.lit(1.0).alias("weight"))
    return l.unionByName(v)


RRF = f"""WITH {BM25}, {COS}, ch AS (SELECT query_id, doc_id AS key, 'lexical' AS channel, rank, 1.25 AS weight FROM bm25 UNION ALL SELECT query_id, vec_id, 'vector', rank, 1.0 FROM vtop),
e AS (SELECT query_id, key, sum(CAST(weight AS DOUBLE) / (60 + rank)) AS raw, min(CASE WHEN channel = 'vector' THEN rank END) AS v, min(CASE WHEN channel = 'lexical' THEN rank END) AS l FROM ch GROUP BY 1, 2),
m AS (SELECT query_id, coalesce(max(CASE WHEN channel = 'vector' THEN rank END), 0) AS vl, coalesce(max(CASE WHEN channel = 'lexical' THEN rank END), 0) AS ll FROM ch GROUP BY 1),
f AS (SELECT query_id, key, raw, coalesce(v, vl + 1) AS vector_rank, coalesce(l, ll + 1) AS lexical_rank FROM e JOIN m USING (query_id)),
rrf AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, vector_rank, lexical_rank, key) AS INTEGER) AS rank, key, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score, vector_rank, lexical_rank FROM f) WHERE rank <= 10)"""


@query(f"{RRF} SELECT * FROM rrf")
def r8_rank_fusion(spark, sf):
    return retrieval.fuse(channels(spark, sf), 10)


@query(f"{RRF}, u AS (SELECT query_id, key, 0 AS part, rank FROM rrf UNION ALL SELECT query_id, vec_id, 1, rank FROM vtop), o AS (SELECT query_id, key, min(struct_pack(part := part, rank := rank)) AS spot FROM u GROUP BY 1, 2) SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spot) AS INTEGER) AS rank, key FROM o) WHERE rank <= 15")
def d3_merge_ranked(spark, sf):
    near = corpus.tabled(by_vector(spark, sf), "near")
    v = near.select("query_id", "rank", F.col("vec_id").alias("key"))
    return retrieval.merge_ranked(retrieval.fuse(channels(spark, sf, near), 10).select("query_id", "rank", "key"), v, 15)


@query(rf"""WITH {BM25}, c AS (SELECT b.query_id, b.doc_id, 1.0 / (60 + b.rank) AS base, d.text, d.source, 'src' || (b.query_id % 20) AS company, {WORDS.format("k.text")} AS terms FROM bm25 b JOIN documents d USING (doc_id) JOIN benchmark k ON k.item_id = b.query_id),
s AS (SELECT query_id, doc_id, round(CAST(base AS DOUBLE) + least(len(list_intersect(list_distinct(terms), list_distinct({WORDS.format("text")}))) * 0.005, 0.02) + CASE WHEN source = company THEN 0.02 ELSE 0.0 END + CASE WHEN contains(text, ' | ') THEN 0.01 ELSE 0.0 END, 6) AS score FROM c)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s) WHERE rank <= 10""")
def r11_rerank(spark, sf):
    # few rows, of known size: the texts are not shuffled to meet them
    base = corpus.tabled(lexical(spark, sf), "ranked").select("query_id", "doc_id", (1 / (60 + F.col("rank"))).alias("base"))
    q = asked(spark, sf).select("query_id", T.words("text").alias("terms"), F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("company"))
    c = base.join(S.documents(spark, sf).select("doc_id", "text", "source"), "doc_id").join(q, "query_id")
    return retrieval.rerank(c, "terms", 10)


#: Terms of the questions that have a hint.
HINTS = [("that", "thation"), ("with", "thation"), ("from", "ment"), ("this", "ther")]
QUESTIONS = f"""SELECT item_id AS query_id, text, item_id % 4 + 2 AS top_k, item_id % 3 AS tenant_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'xx' END AS lang, item_id % 5 = 0 AS wide, list_sort(list_distinct(list_transform(list_filter([{", ".join(f"['{t}', '{h}']" for t, h in HINTS)}], lambda h: list_contains({WORDS.format("text")}, h[1])), lambda h: h[2]))) AS hints FROM benchmark"""
RETRIEVE = (
    "WITH " + BM25.replace("SELECT item_id AS query_id, unnest(" + WORDS.format("text") + ") AS term FROM benchmark", "SELECT query_id, unnest(" + WORDS.format("text || ' ' || array_to_string(hints, ' ')") + ") AS term FROM questions").replace("tok AS", f"questions AS MATERIALIZED ({QUESTIONS}), tok AS", 1)
    + f""", {COS.replace("rank <= 20", f"rank <= {5 * 8 * 8}")},
both_channels AS (SELECT query_id, doc_id, score, 'lexical' AS channel FROM scored UNION ALL SELECT query_id, vec_id, score, 'vector' FROM vtop),
seen AS (SELECT c.query_id, c.doc_id, c.score, channel, top_k, top_k * CASE WHEN wide THEN 8 ELSE 4 END AS pool, CASE WHEN q.lang IS NULL OR q.lang = d.lang THEN 1 ELSE 2 END AS stage, len(hints) > 0 AS enriched FROM both_channels c JOIN questions q USING (query_id) JOIN documents d USING (doc_id) WHERE d.doc_id % 3 = q.tenant_id OR d.doc_id % 3 = 0),
ok AS (SELECT * FROM (SELECT *, count(*) FILTER (stage = 1) OVER (PARTITION BY query_id, channel) AS own FROM seen) WHERE stage = 1 OR own < top_k),
pools AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY stage, score DESC, doc_id) AS rank FROM ok) WHERE rank <= pool),
each_key AS (SELECT query_id, doc_id, sum(CASE WHEN channel = 'lexical' AND enriched THEN 1.25 ELSE 1.0 END / (60 + rank)) AS raw, min(CASE WHEN channel = 'vector' THEN rank END) AS v, min(CASE WHEN channel = 'lexical' THEN rank END) AS l, min(stage) AS stage FROM pools GROUP BY 1, 2),
ranks AS (SELECT *, coalesce(v, coalesce(max(v) OVER w, 0) + 1) AS vr, coalesce(l, coalesce(max(l) OVER w, 0) + 1) AS lr FROM each_key WINDOW w AS (PARTITION BY query_id)),
first_ones AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, vr, lr, doc_id) AS n, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS fused FROM ranks) WHERE n <= (SELECT max(top_k * CASE WHEN wide THEN 8 ELSE 4 END) FROM questions)),
last_score AS (SELECT f.query_id, f.doc_id, stage, vr, lr, top_k, round(fused + least(0.005 * len(list_intersect(list_distinct({WORDS.format("q.text")}), list_distinct({WORDS.format("d.text")}))), 0.02), 6) AS score FROM first_ones f JOIN questions q USING (query_id) JOIN documents d USING (doc_id))
SELECT query_id, rank, doc_id, score, stage, CAST(vr AS INTEGER) AS vector_rank, CAST(lr AS INTEGER) AS lexical_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr, lr, doc_id) AS INTEGER) AS rank FROM last_score) WHERE rank <= top_k"""
)


@query(RETRIEVE)
def r10_retrieve(spark, sf):
    """Every benchmark passage as a question of its own size, tenant, language and scope."""
    item = F.col("item_id")
    questions = S.read(spark, sf, "benchmark").select(item.alias("query_id"), "text", (item % 4 + 2).alias("top_k"), (item % 3).alias("tenant_id"), F.when(item % 4 == 0, "en").when(item % 4 == 1, "xx").alias("lang"), F.when(item % 5 == 0, "summary").otherwise("point").alias("scope"))
    hints = spark.createDataFrame(HINTS, "term string, hint string")
    return retrieval.retrieve(S.documents(spark, sf), S.read(spark, sf, "embeddings"), questions, vector_queries(spark, sf), hints)


TEXT_KEY = r"sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY {TEXT_KEY} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def d2_deduplicate(spark, sf):
    return retrieval.first_of_each(S.documents(spark, sf), T.content_hash("text"), [F.col("doc_id")]).select("doc_id", "source")


@query(f"SELECT source, doc_id, {TEXT_KEY} AS content_hash FROM documents")
def d7_content_hash(spark, sf):
    return S.documents(spark, sf).select("source", "doc_id", T.content_hash("text").alias("content_hash"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, {TEXT_KEY} ORDER BY CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END DESC, doc_id) AS n FROM documents) WHERE n = 1")
def d5_by_authority(spark, sf):
    return corpus.by_authority(S.documents(spark, sf)).select("doc_id")


@query(f"SELECT doc_id FROM documents d WHERE doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id % 3 = 0 AND p.source = d.source AND {TEXT_KEY.replace('text', 'p.text')} = {TEXT_KEY.replace('text', 'd.text')})")
def j8_private_without_public(spark, sf):
    return corpus.private_without_public(S.documents(spark, sf)).select("doc_id")


@query("SELECT doc_id % 3 AS tenant_id, sha256(text) AS content_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2")
def d6_document_registry(spark, sf):
    return corpus.registry(S.documents(spark, sf))


@query(rf"WITH t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS token FROM documents), c AS (SELECT doc_id, CAST(('0x' || substr(sha256('733:' || token), 9, 8)) AS BIGINT) % 512 AS dim, count(*) AS n FROM t GROUP BY 1, 2) SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c")
def e13_seeded_embedding(spark, sf):
    return retrieval.seeded_embedding(S.documents(spark, sf))


EXPECT = "same AS (SELECT q.vec_id // 100 AS query_id, e.vec_id AS doc_id FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 100 = 0)"
METRICS = f"""WITH {COS}, {EXPECT}, x AS (SELECT query_id, count(*) AS expected FROM same GROUP BY 1),
h AS (SELECT v.query_id, count(*) AS returned, count(s.doc_id) AS hits, min(CASE WHEN s.doc_id IS NOT NULL THEN rank END) AS first, sum(CASE WHEN s.doc_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM (SELECT * FROM vtop WHERE rank <= 10) v LEFT JOIN same s ON s.query_id = v.query_id AND s.doc_id = v.vec_id GROUP BY 1),
m AS (SELECT query_id, round(100.0 * hits / returned, 4) AS precision, round(100.0 * hits / expected, 4) AS recall, round(coalesce(100.0 / first, 0), 4) AS mrr, round(100 * dcg / list_sum(list_transform(generate_series(1, greatest(least(expected, 10), 1)), lambda i: 1 / log2(i + 1))), 4) AS ndcg FROM h JOIN x USING (query_id))"""


def found(spark, sf):
    return by_vector(spark, sf).withColumnRenamed("vec_id", "doc_id")


def judged(spark, sf):
    """Ranked vectors marked where they have the label of their query, and how many have it in all."""
    e = S.read(spark, sf, "embeddings")
    queries = e.where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("query_id"), "label")
    return evaluation.by_label(found(spark, sf), queries, e.select(F.col("vec_id").alias("doc_id"), "label"))


def measured(spark, sf):
    return evaluation.metrics_of_hits(*judged(spark, sf), 10)


@query(f"{METRICS} SELECT * FROM m")
def e1_ranked_metrics(spark, sf):
    return measured(spark, sf)


@query(f"WITH {COS}, {EXPECT}, x AS (SELECT query_id, count(*) AS expected FROM same GROUP BY 1), f AS (SELECT v.query_id, count(*) FILTER (rank <= 4) AS k4, count(*) FILTER (rank <= 8) AS k8, count(*) FILTER (rank <= 12) AS k12 FROM vtop v JOIN same s ON s.query_id = v.query_id AND s.doc_id = v.vec_id GROUP BY 1) SELECT count(*) AS queries, round(100 * avg(coalesce(k4, 0) / expected), 4) AS recall_4, round(100 * avg(coalesce(k8, 0) / expected), 4) AS recall_8, round(100 * avg(coalesce(k12, 0) / expected), 4) AS recall_12 FROM x LEFT JOIN f USING (query_id)")
def a24_recall_at(spark, sf):
    return evaluation.recall_of_hits(*judged(spark, sf), [4, 8, 12])


@query(f"{METRICS} SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round((avg(precision) + avg(recall) + avg(mrr) + avg(ndcg)) / 4, 4) AS gate, bool_and(recall >= 1) AS passed FROM m")
def a23_gate(spark, sf):
    m = measured(spark, sf)
    names = ["precision", "recall", "mrr", "ndcg"]
    mean = F.avg("precision") + F.avg("recall") + F.avg("mrr") + F.avg("ndcg")
    return m.agg(*(F.round(F.avg(c), 4).alias(c) for c in names), F.round(mean / 4, 4).alias("gate"), F.every(F.col("recall") >= 1).alias("passed"))


@query(f"WITH {BM25} SELECT query_id, doc_id FROM bm25 WHERE NOT (doc_id % 3 = query_id % 3 OR doc_id % 3 = 0)")
def e8_tenant_leaks(spark, sf):
    ranked = corpus.tabled(lexical(spark, sf), "ranked").join(S.documents(spark, sf).select("doc_id", "tenant_id"), "doc_id", "left")
    return ranked.where(~retrieval.in_scope(F.col("tenant_id"), F.col("query_id") % 3, include_public=True)).select("query_id", "doc_id")


@query("WITH s AS (SELECT conv_id, list_distinct(list(role)) AS found FROM conversations GROUP BY 1), e AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN [] WHEN conv_id % 3 = 1 THEN ['user', 'assistant'] ELSE ['user', 'tool'] END AS expected FROM s) SELECT conv_id, CASE WHEN len(expected) = 0 THEN 100.0 ELSE round(coalesce(200.0 * len(list_intersect(found, expected)) / (len(found) + len(expected)), 0), 4) END AS f1 FROM e")
def e2_set_f1(spark, sf):
    s = S.messages(spark, sf).groupBy("conv_id").agg(F.collect_set("role").alias("found"))
    want = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("conv_id") % 3 == 1, F.array(F.lit("user"), F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("tool")))
    return s.select("conv_id", evaluation.set_f1(F.col("found"), want).alias("f1"))


@query(r"SELECT conv_id, turn, round((least(length(text) / 200, 1) * 100 + (CASE WHEN contains(lower(text), 'the') THEN 50 ELSE 0 END + CASE WHEN contains(lower(text), 'de') THEN 50 ELSE 0 END) + CASE WHEN regexp_matches(lower(text), '\b(cannot|unable|sorry)\b') THEN 0 ELSE 100 END) / 3, 4) AS score FROM conversations WHERE role = 'assistant'")
def e3_answer_quality(spark, sf):
    return S.messages(spark, sf).where("role = 'assistant'").select("conv_id", "turn", evaluation.answer_quality(F.col("text"), F.array(F.lit("the"), F.lit("de"))).alias("score"))


@query("SELECT doc_id, round(0.25 * quality * 100 + 0.20 * 50 + 0.35 * (1 - toxic) * 100 + 0.20 * 80, 4) AS overall FROM labels")
def e5_overall(spark, sf):
    return S.read(spark, sf, "labels").select("doc_id", evaluation.overall(F.col("quality") * 100.0, F.lit(50.0), (1 - F.col("toxic")) * 100.0, F.lit(80.0)).alias("overall"))


@query(f"{METRICS}, n AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN recall ELSE recall + query_id % 4 - 2 END AS recall FROM m WHERE query_id % 5 <> 4), j AS (SELECT m.recall AS o, n.recall AS w FROM m FULL JOIN n USING (query_id)) SELECT CASE WHEN o IS NULL OR w IS NULL THEN 'UNCOMPARABLE' WHEN w > o THEN 'IMPROVED' WHEN w < o THEN 'REGRESSED' ELSE 'UNCHANGED' END AS verdict, count(*) AS queries FROM j GROUP BY 1")
def y8_compare_runs(spark, sf):
    """Against a new run over all queries but each fifth."""
    m = measured(spark, sf)
    q = F.col("query_id")
    new = m.where(q % 5 != 4).withColumn("recall", F.when(q % 2 == 0, F.col("recall")).otherwise(F.col("recall") + q % 4 - 2))
    return evaluation.compare_runs(m, new)


@query("SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS sizes, 0 AS not_finite, count(*) FILTER (list_sum(list_transform(embedding, lambda x: abs(x))) = 0) AS zero, count(*) - count(DISTINCT vec_id) AS repeated_ids FROM embeddings")
def y10_vector_audit(spark, sf):
    return corpus.vector_audit(S.read(spark, sf, "embeddings"))
