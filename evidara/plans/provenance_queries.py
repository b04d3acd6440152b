"""Stored facts and where they come from, answers against evidence, follow-ups, headings and small chunks. The SQL reads the same tables and works
the answer out in its own way."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidara.functions import blocks as B
from evidara.operators import chunking, citations, provenance
from evidara.plans.registry import query
from evidara.plans.structure_queries import COUNT_WORDS, LINE, item_id, text_lines
from evidara.sources import tables as S

ITEM = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"

#: Orders as stored facts of their customers, and customers' years as requests.
STORED = """f AS (SELECT o_orderkey AS fact_id, o_orderkey % 997 AS document_id, 1 + o_custkey % 3 AS tenant_id, 'c' || o_custkey AS company, o_orderpriority AS metric, year(o_orderdate) AS fiscal_year, CASE o_orderstatus WHEN 'F' THEN 'INSTANT' ELSE 'DURATION' END AS period_type, o_orderkey % 7 <> 0 AS full_year, CASE o_orderkey % 4 WHEN 0 THEN 'PARENT_COMPANY' ELSE 'CONSOLIDATED' END AS scope, CAST(round(CAST(o_totalprice AS DECIMAL(15,2)), 0) AS BIGINT) % 5 AS value, CASE o_orderkey % 11 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'SUPPORTED' ELSE 'EXACT' END AS mapping_status, CASE o_orderkey % 13 WHEN 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verification_status, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 90 END AS page FROM orders),
d AS (SELECT document_id, 1 + document_id % 3 AS tenant_id FROM (SELECT DISTINCT o_orderkey % 997 AS document_id FROM orders) WHERE document_id % 19 <> 0),
q AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 23 <> 0 THEN 1 + o_custkey % 3 ELSE 0 END AS tenant_id, 'c' || o_custkey AS company, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderpriority END AS metric, year(o_orderdate) AS fiscal_year, CASE o_orderstatus WHEN 'F' THEN 'INSTANT' ELSE 'DURATION' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'PARENT_COMPANY' ELSE 'CONSOLIDATED' END AS scope, CASE WHEN o_orderkey % 5 = 0 THEN 'PARENT_COMPANY' END AS named FROM orders)"""


def stored(spark, sf):
    o, k = S.read(spark, sf, "orders"), F.col("o_orderkey")
    period = F.when(F.col("o_orderstatus") == "F", "INSTANT").otherwise("DURATION")
    subject = [F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("company"), F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("fiscal_year")]
    facts = o.select(k.alias("fact_id"), (k % 997).alias("document_id"), (1 + F.col("o_custkey") % 3).alias("tenant_id"), *subject, period.alias("period_type"), (k % 7 != 0).alias("full_year"), F.when(k % 4 == 0, provenance.PARENT).otherwise(provenance.CONSOLIDATED).alias("scope"), F.col("o_totalprice").cast("decimal(15,2)").alias("price"), F.when(k % 11 == 0, "AMBIGUOUS").when(k % 11 == 1, "SUPPORTED").otherwise("EXACT").alias("mapping_status"), F.when(k % 13 == 0, "UNVERIFIED").otherwise("VERIFIED").alias("verification_status"), F.when(k % 17 != 0, k % 90).alias("page"), F.lit("as filed").alias("source_text"))
    facts = facts.withColumn("value", F.round("price", 0).cast("long") % 5)
    documents = o.select((k % 997).alias("document_id")).distinct().where("document_id % 19 <> 0").withColumn("tenant_id", 1 + F.col("document_id") % 3)
    semantics = F.when(F.col("o_orderstatus") == "F", "point_in_time").otherwise("duration")
    requests = o.select(k.alias("request_id"), F.when(k % 23 != 0, 1 + F.col("o_custkey") % 3).otherwise(0).alias("tenant_id"), subject[0], F.when(k % 29 != 0, F.col("o_orderpriority")).alias("metric"), subject[2], semantics.alias("semantics"), F.when(k % 5 == 0, provenance.PARENT).alias("scope"))
    return requests, facts, documents


ANSWERED = f"""WITH {STORED}, m AS (SELECT q.*, f.fact_id, f.document_id, f.value, f.mapping_status, f.verification_status, f.page, f.period_type = 'INSTANT' OR f.full_year AS fits FROM q LEFT JOIN f ON f.tenant_id = q.tenant_id AND f.company = q.company AND f.metric = q.metric AND f.fiscal_year = q.fiscal_year AND f.period_type = q.kind AND f.scope = q.scope),
a AS (SELECT request_id, any_value(tenant_id) AS tenant_id, any_value(metric) AS metric, any_value(scope) AS scope, any_value(company) AS company, any_value(fiscal_year) AS fiscal_year, any_value(kind) AS kind, count(DISTINCT value) AS vs, count(*) FILTER (fits) AS n, min(fact_id) FILTER (fits) AS fact_id FROM m GROUP BY request_id),
r AS (SELECT a.*, f.document_id, f.value, f.mapping_status, f.verification_status, f.page, d.tenant_id AS owner, EXISTS (SELECT 1 FROM f p WHERE p.tenant_id = a.tenant_id AND p.company = a.company AND p.metric = a.metric AND p.fiscal_year = a.fiscal_year AND p.period_type = a.kind AND p.scope = 'PARENT_COMPANY' AND (p.period_type = 'INSTANT' OR p.full_year)) AS parent FROM a LEFT JOIN f ON f.fact_id = a.fact_id LEFT JOIN d ON d.document_id = f.document_id),
w AS (SELECT *, CASE WHEN metric IS NULL THEN 1 WHEN tenant_id = 0 THEN 2 WHEN vs > 1 THEN 3 WHEN n > 1 THEN 4 WHEN n = 0 AND scope = 'CONSOLIDATED' AND parent THEN 5 WHEN n = 0 THEN 6 WHEN owner IS NULL OR owner <> tenant_id THEN 7 WHEN mapping_status = 'AMBIGUOUS' OR verification_status <> 'VERIFIED' THEN 8 WHEN page IS NULL THEN 9 ELSE 0 END AS c FROM r)
SELECT request_id, CASE c WHEN 0 THEN 'FOUND' WHEN 1 THEN 'UNSUPPORTED_METRIC' WHEN 8 THEN 'UNSUPPORTED_METRIC' WHEN 2 THEN 'UNSUPPORTED_QUERY' WHEN 3 THEN 'CONFLICT' WHEN 4 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS status,
CASE c WHEN 1 THEN 'query_metric_has_no_safe_registry_mapping' WHEN 2 THEN 'explicit_tenant_company_or_period_missing' WHEN 3 THEN 'persisted_fact_conflict' WHEN 4 THEN 'multiple_matching_facts_or_document_versions' WHEN 5 THEN 'consolidated_scope_missing_parent_only_exists' WHEN 6 THEN 'no_matching_persisted_fact' WHEN 7 THEN 'fact_document_tenant_scope_validation_failed' WHEN 8 THEN 'stored_fact_failed_company_period_scope_or_metric_validation' WHEN 9 THEN 'citation_provenance_incomplete' END AS reason,
CASE c WHEN 0 THEN 'STRUCTURED_FINANCIAL_FACT' WHEN 2 THEN 'HYBRID_RAG' WHEN 6 THEN 'HYBRID_RAG' WHEN 4 THEN 'STRUCTURED_CLARIFICATION' ELSE 'STRUCTURED_SAFE_FAILURE' END AS route, CASE WHEN c = 0 THEN fact_id END AS fact_id, CASE WHEN c = 0 THEN value END AS value FROM w"""


@query(ANSWERED)
def q14_structured_lookup(spark, sf):
    """Every order asks for its customer's figure of the year; the orders are the stored facts."""
    return provenance.structured_lookup(*stored(spark, sf))


@query(f"""WITH {STORED}, y AS (SELECT company, metric, scope, fiscal_year, count(*) AS n, count(DISTINCT value) > 1 AS differ FROM f GROUP BY ALL),
p AS (SELECT request_id, q.scope, CASE WHEN named IS NULL THEN 'preferred_scope:CONSOLIDATED' ELSE 'explicit_scope' END AS reason, request_id % 3 = 0 AS latest, y.fiscal_year, n, differ FROM q LEFT JOIN y ON y.company = q.company AND y.metric = q.metric AND y.scope = q.scope AND (request_id % 3 <> 1 OR y.fiscal_year = q.fiscal_year))
SELECT request_id, scope, reason || CASE WHEN latest THEN ';latest_from_stored_fiscal_year' ELSE '' END AS reason, CASE WHEN latest THEN max(fiscal_year) END AS fiscal_year, CAST(coalesce(CASE WHEN latest THEN max_by(n, fiscal_year) ELSE sum(n) END, 0) AS BIGINT) AS facts, count(*) FILTER (differ) AS conflicts FROM p GROUP BY request_id, scope, reason, latest""")
def z3_scoped_facts(spark, sf):
    """The same requests, a third for their year, a third for the latest and a third for all years."""
    requests, facts, _ = stored(spark, sf)
    k = F.col("request_id")
    return provenance.scoped_facts(requests.withColumns({"fiscal_year": F.when(k % 3 == 1, F.col("fiscal_year")), "latest": k % 3 == 0}), facts)


ROWS = f"SELECT l_orderkey, l_partkey % 50 AS page, CAST(l_quantity AS BIGINT) AS value, l_returnflag AS label, {ITEM} AS row_id, l_linestatus = 'O' OR l_linenumber > 1 AS eligible FROM lineitem"


@query(f"""WITH r AS (SELECT DISTINCT * FROM ({ROWS}) WHERE eligible), k AS (SELECT l_orderkey, page, value, label, count(*) AS n, min(row_id) AS row_id FROM r GROUP BY ALL),
f AS (SELECT l_orderkey, {ITEM} AS fact_id, l_partkey % 50 AS page, CAST(l_quantity AS BIGINT) + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS value, l_returnflag AS label FROM lineitem),
b AS (SELECT f.*, CASE WHEN n = 1 THEN 'BOUND' WHEN n > 1 THEN 'SEVERAL_ROWS' ELSE 'NO_ROW' END AS status, CASE WHEN n = 1 THEN k.row_id END AS row_id FROM f LEFT JOIN k USING (l_orderkey, page, value, label))
SELECT *, CASE WHEN status = 'BOUND' THEN sha256('=true' || chr(31) || '=' || l_orderkey || chr(31) || '=' || label || chr(31) || '=' || page || chr(31) || '=' || row_id || chr(31) || '=' || value) END AS row_digest, bool_and(status = 'BOUND') OVER (PARTITION BY l_orderkey) AS document_bound FROM (SELECT l_orderkey, fact_id, page, value, label, status, row_id FROM b)""")
def y7_bound_facts(spark, sf):
    """Line items as rows of their order; as facts too, a ninth with another value."""
    l = S.read(spark, sf, "lineitem")
    said = [F.col("l_orderkey"), (F.col("l_partkey") % 50).alias("page"), F.col("l_quantity").cast("long").alias("value"), F.col("l_returnflag").alias("label")]
    rows = l.select(*said, item_id().alias("row_id"), ((F.col("l_linestatus") == "O") | (F.col("l_linenumber") > 1)).alias("eligible"))
    off = F.when(F.col("l_suppkey") % 9 == 0, 1).otherwise(0)
    facts = l.select(said[0], item_id().alias("fact_id"), said[1], (F.col("l_quantity").cast("long") + off).alias("value"), said[3])
    return provenance.bind_rows(facts, rows, "l_orderkey", ["page", "value", "label"])


@query("""WITH s AS (SELECT o_orderkey AS t, o_custkey AS c, o_orderstatus AS os, o_orderpriority AS op, unnest(range(1, 6)) AS i FROM orders),
x AS (SELECT t, i, t % 31 = i AS other, (t * 7 + c) % 37 = i AS open, c % 41 = i AS ref, c % 17 = 0 AS quality, t % 43 = 0 AS stale, t % 47 = 0 AS loose, os, op FROM s WHERE NOT (t % 53 = i))
SELECT t AS task_id, CASE WHEN bool_or(other) THEN 'DOCUMENT_IDENTITY_CHANGED' WHEN count(*) < 5 OR bool_or(open) THEN 'STAGE_INCOMPLETE' WHEN any_value(op) LIKE '5%' AND any_value(os) = 'P' THEN 'TERMINAL_FAILURE' WHEN bool_or(ref) THEN 'ARTIFACT_REFERENCE_INVALID' WHEN bool_or(quality) THEN 'QUALITY_GATE_FAILED' WHEN bool_or(stale) THEN 'ARTIFACT_DEPENDENCY_MISMATCH' WHEN bool_or(loose) THEN 'TREE_EVIDENCE_INVALID' WHEN any_value(os) = 'F' AND any_value(op) LIKE '1%' THEN 'FINAL_STATE_INCONSISTENT' ELSE 'READY' END AS verdict FROM x GROUP BY t""")
def z20_promotable(spark, sf):
    """Orders as tasks with five stages each, some of them open, stale or of another source."""
    k, c = F.col("task_id"), F.col("o_custkey")
    o = S.read(spark, sf, "orders").withColumnRenamed("o_orderkey", "task_id")
    failed = F.col("o_orderpriority").startswith("5") & (F.col("o_orderstatus") == "P")
    half = F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "F")
    tasks = o.select("task_id", F.when(failed, "quarantined").when(F.col("o_orderstatus") == "F", "ready").otherwise("processing").alias("document_status"), F.when((F.col("o_orderstatus") == "F") & ~half, "success").otherwise("running").alias("task_status"), F.sha2(k.cast("string"), 256).alias("content_sha256"))
    made = lambda i: F.sha2(F.concat_ws("/", k.cast("string"), F.lit(i).cast("string") if isinstance(i, int) else i.cast("string")), 256)
    i = F.col("i")
    of = o.select("task_id", "o_custkey", F.posexplode(F.array(*map(F.lit, provenance.STAGES))).alias("i", "stage")).withColumn("i", i + 1).where(k % 53 != i)
    stages = of.select(
        "task_id", "stage",
        F.when((k * 7 + c) % 37 == i, "running").otherwise("complete").alias("status"),
        F.sha2(F.when(k % 31 == i, F.lit("other")).otherwise(k.cast("string")), 256).alias("source_sha256"),
        F.when(c % 41 == i, F.lit("lost")).otherwise(made(i)).alias("artifact_id"),
        made(i).alias("artifact_sha256"),
        F.when(k % 43 == 0, F.when(i.isin(3, 5), made(9)).otherwise(made(1))).otherwise(made(1)).alias("parse_sha256"),
        F.when((k % 47 == 0) & (i == 4), made(9)).otherwise(made(2)).alias("quality_sha256"),
        F.when(c % 17 == 0, "REVIEW").otherwise("PASS").alias("quality_status"),
    )
    return provenance.promotable(tasks, stages)


@query("""WITH p AS (SELECT o_custkey AS c, o_orderkey, o_custkey % 4 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, CAST(o_totalprice AS DECIMAL(15,2)) AS price FROM orders),
a AS (SELECT c, min(price) FILTER (place = 2) AS said, count(*) AS n FROM p GROUP BY c),
h AS (SELECT p.*, n, k = 0 AND price = said OR k = 3 AND n >= 2 AND place = 1 AS held FROM p JOIN a USING (c))
SELECT c AS question_id, place, CASE WHEN k = 1 OR k = 0 AND n < 2 THEN NULL WHEN held THEN 'supported' ELSE 'unverified' END AS support FROM (SELECT *, bool_or(held) OVER (PARTITION BY c) AS any_held FROM h) WHERE k = 1 OR k = 0 AND n < 2 OR held OR NOT any_held AND place = 1""")
def f12_supported(spark, sf):
    """A customer's orders as evidence: answers with the second one's figure, without a figure, with a wrong one, and with a growth."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    price = F.format_string("%.2f", F.col("o_totalprice"))
    p = S.read(spark, sf, "orders").select(F.col("o_custkey").alias("question_id"), place.alias("place"), price.alias("price"))
    kind = F.col("question_id") % 4
    rise = F.when((kind == 3) & (F.col("place") == 1), F.lit("Sales of $150 million after $120 million")).otherwise(F.concat(F.lit("Net sales were $"), F.col("price"), F.lit(" million")))
    second = p.groupBy("question_id").agg(F.max(F.when(F.col("place") == 2, F.col("price"))).alias("said"), F.count("*").alias("n"))
    answer = F.when(kind == 0, F.coalesce(F.concat(F.lit("They were $"), F.col("said"), F.lit(" million.")), F.lit("Unknown."))).when(kind == 1, "No figure was given.").when(kind == 2, "They were EUR 77 trillion.").when(F.col("n") >= 2, "The growth was 25.0%.").otherwise("It moved by 25.0%.")
    return citations.supported_evidence(p.select("question_id", "place", rise.alias("content")), second.select("question_id", answer.alias("answer")))


WORDS_OF = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"


@query(f"""WITH t AS (SELECT conv_id, turn, max(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1, 2), u AS (SELECT conv_id, turn + 1 AS turn, max(text) AS asked FROM conversations WHERE role = 'user' GROUP BY 1, 2),
j AS (SELECT conv_id, turn, text, {WORDS_OF.format('text')} AS w, list_distinct({WORDS_OF.format('asked')}) AS a, coalesce(asked, '') AS asked FROM t LEFT JOIN u USING (conv_id, turn)),
s AS (SELECT *, array_to_string(w, ' ') AS flat, list_filter(string_split(asked, ' '), lambda x: length(x) > 5) AS claims FROM j)
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN round(100.0::DOUBLE * (contains(flat, 'die')::INT + contains(flat, 'tion de')::INT + contains(flat, 'ment')::INT) / 3, 2) WHEN asked <> '' THEN CASE WHEN len(a) = 0 THEN 100 ELSE round(100.0::DOUBLE * len(list_filter(a, lambda x: list_contains(w, x))) / len(a), 2) END WHEN trim(coalesce(text, '')) <> '' THEN 100 ELSE 0 END AS quality,
CASE WHEN len(claims) = 0 THEN 100 ELSE round(len(list_filter(claims, lambda x: contains(lower(coalesce(text, '')), lower(x))))::DOUBLE / len(claims) * 100, 1) END AS coverage FROM s""")
def x30_lexical_quality(spark, sf):
    """Each answer against the user's turn before it, or for every second against three terms; its longer words are the claims."""
    m = S.messages(spark, sf)
    t = m.where("role = 'assistant'").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    u = m.where("role = 'user'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.max("text").alias("asked"))
    terms = F.when(F.col("turn") % 4 == 3, F.array(F.lit("Die"), F.lit("tion  de"), F.lit("ment")))
    claims = F.filter(F.split(F.coalesce("asked", F.lit("")), " "), lambda x: F.length(x) > 5)
    j = t.join(u, ["conv_id", "turn"], "left")
    return j.select("conv_id", "turn", citations.lexical_quality("text", terms, "asked").alias("quality"), citations.claim_coverage("text", claims).alias("coverage"))


NAMES = ["heit", "ment", "tion", "ing "]
POINTS_BACK = ["und", "les", "the"]


@query(f"""WITH RECURSIVE u AS (SELECT conv_id, turn, max(text) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1, 2),
m AS MATERIALIZED (SELECT conv_id, turn, {" OR ".join(f"contains(lower(text), ' {w} ')" for w in POINTS_BACK)} AS refers, list_filter({NAMES!r}, lambda n: contains(lower(text), n)) AS names, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM u),
w AS (SELECT m.conv_id, m.turn, p.turn AS prior, p.r, p.names, p.refers FROM m JOIN m p ON p.conv_id = m.conv_id AND p.r = m.r - 1 WHERE m.refers
UNION ALL SELECT w.conv_id, w.turn, p.turn, p.r, p.names, p.refers FROM w JOIN m p ON p.conv_id = w.conv_id AND p.r = w.r - 1 WHERE len(w.names) = 0 AND w.refers)
SELECT conv_id, turn, CAST(prior AS BIGINT) AS prior_turn, array_to_string(names, ',') AS entities FROM w WHERE len(names) > 0""")
def x18_prior_requests(spark, sf):
    """User turns that hold a pointing word, and the earlier turn that they mean."""
    text = F.lower("text")
    refers = F.exists(F.array(*map(F.lit, POINTS_BACK)), lambda w: F.contains(text, F.concat(F.lit(" "), w, F.lit(" "))))
    names = F.filter(F.array(*map(F.lit, NAMES)), lambda n: F.contains(text, n))
    return citations.prior_requests(S.messages(spark, sf), refers, names).withColumn("entities", F.array_join("entities", ","))


SPACES = r"[ \t\n\x0b\f\r]+"


CLAUSE = r"[.,;!?\n]+ *"


@query(rf"""WITH p AS (SELECT doc_id, unnest(ps) AS t, unnest(range(0, len(ps))) AS place FROM (SELECT doc_id, string_split_regex(text, '{CLAUSE}') AS ps FROM documents WHERE text IS NOT NULL)), b AS (SELECT doc_id, place // (doc_id % 3 + 1) AS block, string_agg(t, chr(10) ORDER BY place) AS raw FROM p GROUP BY 1, 2),
n AS (SELECT *, trim(regexp_replace(raw, '{SPACES}', ' ', 'g')) AS t, len(list_filter(string_split_regex(raw, '[\n\r\x0b\f]'), lambda x: trim(regexp_replace(x, '{SPACES}', ' ', 'g')) <> '')) AS lines FROM b),
c AS (SELECT *, string_split(t, ' ') AS w, regexp_matches(t, '(?i)^(q[1-4]|[1-4]q)([-_/ ]?(fy)?[0-9]{{2,4}})?$') OR regexp_matches(t, '(?i)^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(tember)?|oct(ober)?|nov(ember)?|dec(ember)?) [0-9]{{1,2}},?$') OR length(t) <= 40 AND regexp_matches(t, '[0-9]') AS cell FROM n),
d AS (SELECT *, list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')) AS lw FROM c)
SELECT doc_id, CAST(block AS BIGINT) AS block, cell, CASE WHEN t = '' OR length(t) > 140 OR lines > 2 OR t[-1] IN ('.', '?', '!', '。', '？', '！', ';', '；', ',', '，') OR len(w) > 16 THEN false WHEN regexp_matches(t, '(?i)^(section )?([0-9]+(\.[0-9]+)*|[ivxlcdm]+)[.)]? ') THEN true WHEN cell THEN false WHEN t[-1] IN (':', '：') THEN true
WHEN regexp_matches(t, '\p{{Lu}}') AND NOT regexp_matches(t, '\p{{Ll}}|\p{{Lt}}|[0-9]') AND (length(regexp_replace(t, '\P{{L}}', '', 'g')) >= 6 OR lower(t) IN {tuple(B.ONE_WORD)}) THEN true WHEN regexp_matches(t, '[\x{{3400}}-\x{{9fff}}]') THEN length(t) BETWEEN 4 AND 30 ELSE len(lw) >= 2 AND len(list_filter(lw, lambda x: NOT regexp_matches(x, '^\p{{Lu}}'))) = 0 END AS heading FROM d""")
def x26_headings(spark, sf):
    """Documents in blocks of one to three clauses, a line each."""
    p = S.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", CLAUSE)).alias("place", "t"))
    l = p.groupBy("doc_id", F.floor(F.col("place") / (F.col("doc_id") % 3 + 1)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "t"))).alias("b"))
    l = l.select("doc_id", "block", F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("raw"))
    return l.select("doc_id", "block", B.table_cell(B.one_line("raw")).alias("cell"), B.heading("raw").alias("heading"))


KEY = r"lower(trim(regexp_replace(t, '\s+', ' ', 'g')))"
KEYS = "array_to_string(list_transform({0}.ps, lambda y: y.k), ' ')"
BARE = f"({KEYS} = {{0}}.sk)"
SMALL = f"(length({KEYS}) < 80 OR {BARE})"
CROSS = "({0}.kind = 'table' AND {1}.kind = 'unverified_table' OR {0}.kind = 'unverified_table' AND {1}.kind = 'table')"


def joined_sql(a, b):
    """Chunk b joined to chunk a."""
    follows = f"{BARE.format(a)} AND NOT {BARE.format(b)}"
    taken = ", ".join(f"'{c}': CASE WHEN {follows} THEN {b}.{c} ELSE {a}.{c} END" for c in ("section", "sk"))
    kind = f"CASE WHEN {a}.kind = 'unverified_table' OR {b}.kind = 'unverified_table' THEN 'unverified_table' WHEN {a}.kind = {b}.kind THEN {a}.kind ELSE 'mixed' END"
    return f"{{'ps': list_concat({a}.ps, list_filter({b}.ps, lambda y: NOT list_contains(list_transform({a}.ps, lambda z: z.k), y.k))), 'kind': {kind}, {taken}}}"


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, line // 10 AS page, line, t, {KEY} AS k, {COUNT_WORDS} AS n FROM ({LINE})),
c AS MATERIALIZED (SELECT doc_id, page, list({{'ps': [{{'k': k, 'p': trim(t)}}], 'kind': CASE WHEN n % 5 = 0 THEN 'table' WHEN n % 7 = 0 THEN 'unverified_table' ELSE 'text' END, 'section': CASE WHEN n <= 2 THEN t ELSE 'page ' || page END, 'sk': CASE WHEN n <= 2 THEN k ELSE 'page ' || page END}} ORDER BY line) AS cs FROM l WHERE k <> '' GROUP BY 1, 2),
f AS (SELECT doc_id, page, cs, 1 AS i, 0 AS s, [cs[1]][2:] AS o, cs[1] AS now FROM c
UNION ALL SELECT doc_id, page, cs, CASE WHEN i < len(cs) THEN i + 1 ELSE i END, s + 1,
CASE WHEN i = len(cs) THEN o[:len(o) - 1] WHEN {SMALL.format('now')} AND NOT {CROSS.format('now', 'cs[i + 1]')} THEN o ELSE list_append(o, now) END,
CASE WHEN i = len(cs) THEN {joined_sql('o[len(o)]', 'now')} WHEN {SMALL.format('now')} AND NOT {CROSS.format('now', 'cs[i + 1]')} THEN {joined_sql('now', 'cs[i + 1]')} ELSE cs[i + 1] END
FROM f WHERE i < len(cs) OR len(o) > 0 AND {SMALL.format('now')} AND NOT {CROSS.format('o[len(o)]', 'now')}),
e AS (SELECT doc_id, page, unnest(list_append(o, now)) AS x, generate_subscripts(list_append(o, now), 1) - 1 AS chunk FROM (SELECT DISTINCT ON (doc_id, page) * FROM f ORDER BY doc_id, page, s DESC))
SELECT doc_id, page, CAST(chunk AS INTEGER) AS chunk, array_to_string(list_transform(x.ps, lambda y: y.p), chr(10) || chr(10)) AS text, x.kind AS kind, x.section AS section FROM e""")
def x7_merged_chunks(spark, sf):
    """Ten lines are a page; lines of one or two words are headings, and the number of words says what a line holds."""
    l = text_lines(spark, sf).withColumn("page", F.floor(F.col("line") / 10)).where(chunking.normal("t") != "")
    kind = F.when(F.col("n") % 5 == 0, "table").when(F.col("n") % 7 == 0, "unverified_table").otherwise("text")
    section = F.when(F.col("n") <= 2, F.col("t")).otherwise(F.concat(F.lit("page "), F.col("page").cast("string")))
    return chunking.merge_small_chunks(l.select("doc_id", "page", F.col("line").alias("place"), F.col("t").alias("text"), kind.alias("kind"), section.alias("section")))
