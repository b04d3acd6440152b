"""Fact queries over a view of yearly company figures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidara.functions import numbers as N
from evidara.functions import periods as P
from evidara.operators import corpus, facts
from evidara.plans.registry import query
from evidara.sources import tables as S
from evidara.sources import versioned

FACTS = """w AS (SELECT n_name AS company, year(o_orderdate) AS fiscal_year, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS revenue,
sum(CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(6,4)) AS DECIMAL(18,4))) AS discounts,
sum(CAST(CAST(l_extendedprice AS DECIMAL(18,4)) - CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(6,4)) AS DECIMAL(18,4)) AS DECIMAL(18,4))) AS net_revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
facts AS (SELECT company, fiscal_year, 'revenue' AS metric, revenue AS value FROM w UNION ALL SELECT company, fiscal_year, 'discounts', discounts FROM w UNION ALL SELECT company, fiscal_year, 'net_revenue', net_revenue FROM w)"""


@query(f"WITH {FACTS} SELECT company, fiscal_year, metric, CAST(value AS DOUBLE) AS value FROM facts")
def n10_facts(spark, sf):
    return S.facts(spark, sf).withColumn("value", F.col("value").cast("double"))


def statement_rows(spark, sf):
    """Rows as extracted: some lack a unit, a currency or verification."""
    o = S.read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("company"),
        F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderstatus") == "F", "million").when(F.col("o_orderstatus") == "O", "thousand").otherwise("bushel").alias("unit"),
        F.when(F.col("o_orderkey") % 7 != 0, "USD").alias("currency"),
        F.year("o_orderdate").alias("fiscal_year"),
        F.when(F.col("o_orderpriority").like("1%"), "UNVERIFIED").otherwise("VERIFIED").alias("verification_status"),
    )


@query("SELECT o_orderkey AS row_id, array_to_string(list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'MISSING_COMPANY' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'UNKNOWN_UNIT' END, CASE WHEN o_orderkey % 7 = 0 THEN 'MISSING_CURRENCY' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'UNVERIFIED' END], lambda x: x IS NOT NULL), ',') AS reasons, NOT (o_orderkey % 11 = 0 OR o_orderstatus NOT IN ('F', 'O') OR o_orderkey % 7 = 0 OR o_orderpriority LIKE '1%') AS eligible FROM orders")
def f13_eligibility(spark, sf):
    return facts.eligible(statement_rows(spark, sf)).select("row_id", F.concat_ws(",", "reasons").alias("reasons"), "eligible")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1000000 WHEN 'O' THEN 1000 END AS scale FROM orders")
def n8_unit_scale(spark, sf):
    return statement_rows(spark, sf).select(F.col("row_id").alias("o_orderkey"), N.unit_scale(F.col("unit")).cast("long").alias("scale"))


@query("SELECT o_orderkey, 'ff_' || substr(sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN 'c' || o_custkey END, ''), o_orderstatus)), 1, 24) AS fact_id FROM orders")
def n9_fact_id(spark, sf):
    r = statement_rows(spark, sf).join(S.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("row_id") == F.col("o_orderkey"))
    return r.select("o_orderkey", N.fact_id(F.col("row_id"), F.col("company"), F.col("o_orderstatus")).alias("fact_id"))


PRINTED = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 0 THEN '($1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.25)' ELSE '2,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS printed FROM orders"


@query(f"WITH p AS ({PRINTED}) SELECT o_orderkey, CASE WHEN printed LIKE '(%)' THEN -TRY_CAST(regexp_replace(printed, '[,\\s$()]', '', 'g') AS DOUBLE) ELSE TRY_CAST(regexp_replace(printed, '[,\\s$()]', '', 'g') AS DOUBLE) END AS value FROM p")
def n11_source_number(spark, sf):
    k = F.col("o_orderkey")
    tail = F.lpad((k % 1000).cast("string"), 3, "0")
    printed = F.when(k % 5 == 0, "n/a").when(k % 3 == 0, F.concat(F.lit("($1,"), tail, F.lit(".25)"))).otherwise(F.concat(F.lit("2,"), tail))
    return S.read(spark, sf, "orders").select("o_orderkey", N.source_number(printed).cast("double").alias("value"))


@query("SELECT o_orderkey, o_totalprice = round(o_totalprice) OR abs(o_totalprice - round(o_totalprice)) <= 0.25 AS equal FROM orders")
def n2_equivalent(spark, sf):
    v = F.col("o_totalprice")
    return S.read(spark, sf, "orders").select("o_orderkey", N.equivalent(v, F.round(v), F.lit(0.01), F.lit(0.5)).alias("equal"))


@query(f"WITH {FACTS} SELECT n.company, n.metric, n.fiscal_year, round((CAST(n.value AS DOUBLE) - CAST(b.value AS DOUBLE)) / nullif(CAST(b.value AS DOUBLE), 0) * 100, 6) AS growth FROM facts n JOIN facts b ON n.company = b.company AND n.metric = b.metric AND n.fiscal_year = b.fiscal_year + 1")
def n4_growth(spark, sf):
    return facts.year_on_year(S.facts(spark, sf))


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice - l_quantity * 1000) / abs(l_quantity * 1000) * 100 AS rate FROM lineitem")
def n5_growth_rate(spark, sf):
    return S.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.growth_rate(F.col("l_extendedprice"), F.col("l_quantity") * 1000).alias("rate"))


@query(f"WITH {FACTS} SELECT company, fiscal_year, round(CAST(net_revenue AS DOUBLE) / CAST(revenue AS DOUBLE) * 100, 6) AS margin FROM w")
def n6_margin(spark, sf):
    return facts.margins(S.facts(spark, sf), "net_revenue", "revenue")


@query(f"WITH {FACTS}, e AS (SELECT company, metric, arg_min(CAST(value AS DOUBLE), fiscal_year) AS a, arg_max(CAST(value AS DOUBLE), fiscal_year) AS b, max(fiscal_year) - min(fiscal_year) AS years FROM facts GROUP BY 1, 2) SELECT company, metric, CASE WHEN a > 0 AND b > 0 AND years > 0 THEN round(pow(b / a, 1.0 / years) - 1, 8) END AS cagr FROM e")
def n6_cagr(spark, sf):
    return facts.growth_over_years(S.facts(spark, sf))


@query(f"WITH {FACTS} SELECT company, fiscal_year, CAST(revenue - discounts - net_revenue AS DOUBLE) AS gap, abs(revenue - discounts - net_revenue) <= 0.01 AS balanced FROM w")
def a14_identity_audit(spark, sf):
    return facts.identity_audit(S.facts(spark, sf), "revenue", ["discounts", "net_revenue"]).withColumn("gap", F.col("gap").cast("double"))


REPORTED = "r AS (SELECT 'c' || (o_custkey % 100) AS company, year(o_orderdate) AS fiscal_year, o_orderpriority AS metric, CAST(o_orderkey % 3 AS BIGINT) AS value FROM orders)"


def reported(spark, sf):
    """Figures as reported by several filings of a company and year, some of which disagree."""
    return S.read(spark, sf, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string")).alias("company"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderpriority").alias("metric"), (F.col("o_orderkey") % 3).alias("value"))


RESOLVED = f"{REPORTED}, resolved AS (SELECT company, fiscal_year, metric, count(*) AS rows, CASE WHEN count(DISTINCT value) > 1 THEN 'CONFLICT' ELSE 'OK' END AS status, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value FROM r GROUP BY 1, 2, 3)"
IDENTITY = ["company", "fiscal_year", "metric"]


@query(f"WITH {RESOLVED} SELECT * FROM resolved")
def a16_conflicts(spark, sf):
    return facts.resolve_conflicts(reported(spark, sf), IDENTITY)


@query(f"WITH {RESOLVED}, old AS (SELECT company, fiscal_year, metric, value FROM resolved WHERE status = 'OK' AND fiscal_year < 1996), b AS (SELECT company, fiscal_year, metric, CASE WHEN fiscal_year = 1995 THEN value + 1 ELSE value END AS value FROM r WHERE fiscal_year >= 1994), g AS (SELECT company, fiscal_year, metric, count(DISTINCT value) AS n, min(value) AS v FROM b GROUP BY 1, 2, 3) SELECT g.company, g.fiscal_year, g.metric, CASE WHEN n > 1 THEN 'conflicted' WHEN old.value IS NULL THEN 'inserted' WHEN old.value = g.v THEN 'unchanged' ELSE 'conflicted' END AS outcome FROM g LEFT JOIN old USING (company, fiscal_year, metric)")
def a18_save_batch(spark, sf):
    r = reported(spark, sf)
    old = facts.resolve_conflicts(r, IDENTITY).where("status = 'OK' AND fiscal_year < 1996")
    new = r.where("fiscal_year >= 1994").withColumn("value", F.when(F.col("fiscal_year") == 1995, F.col("value") + 1).otherwise(F.col("value")))
    return facts.save_batch(old, new, IDENTITY)


@query(f"WITH {RESOLVED} SELECT company, fiscal_year, metric, value FROM resolved WHERE status = 'OK'")
def a18_saved_facts(spark, sf):
    """Facts up to 1995 saved; a batch with one value changed, which changes nothing; then the later years, twice."""
    known = facts.resolve_conflicts(reported(spark, sf), IDENTITY).where("status = 'OK'").select(*IDENTITY, "value")
    table = versioned.VersionedTable(spark, f"{corpus.shared_folder(spark)}/facts-{uuid.uuid4().hex}", known.schema, "fiscal_year")
    early, late = known.where("fiscal_year < 1996"), known.where("fiscal_year >= 1996")
    table.save_batch(early, IDENTITY, "value", "early")
    table.save_batch(late.unionByName(early.withColumn("value", F.col("value") + 1)), IDENTITY, "value", "torn")
    for _ in range(2):
        table.save_batch(late, IDENTITY, "value", "late")
    return table.read()


@query(f"WITH {FACTS} SELECT company, metric, fiscal_year, CAST(value AS DOUBLE) AS value FROM (SELECT *, rank() OVER (PARTITION BY company, metric ORDER BY fiscal_year DESC) AS n FROM facts) WHERE n = 1")
def r16_latest(spark, sf):
    return facts.latest(S.facts(spark, sf)).select("company", "metric", "fiscal_year", F.col("value").cast("double").alias("value"))


@query(f"WITH {RESOLVED}, q AS (SELECT p_partkey AS request_id, 'c' || (p_partkey % 120) AS company, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][p_partkey % 5 + 1] AS metric, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1992 + p_partkey % 9 END AS fiscal_year FROM part), g AS (SELECT request_id, count(f.status) AS m, count(*) FILTER (f.status = 'CONFLICT') AS c, min(f.value) AS v FROM q LEFT JOIN resolved f ON q.company = f.company AND q.metric = f.metric AND (q.fiscal_year IS NULL OR q.fiscal_year = f.fiscal_year) GROUP BY 1) SELECT request_id, CASE WHEN c > 0 THEN 'CONFLICT' WHEN m = 0 THEN 'NOT_FOUND' WHEN m > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS status, CASE WHEN c = 0 AND m = 1 THEN v END AS value FROM g")
def r17_fail_closed_lookup(spark, sf):
    k = F.col("p_partkey")
    metric = F.element_at(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])), (k % 5 + 1).cast("int"))
    q = S.read(spark, sf, "part").select(k.alias("request_id"), F.concat(F.lit("c"), (k % 120).cast("string")).alias("company"), metric.alias("metric"), F.when(k % 4 != 0, (1992 + k % 9).cast("int")).alias("fiscal_year"))
    return facts.lookup(q, facts.resolve_conflicts(reported(spark, sf), IDENTITY))


@query(f"WITH {FACTS}, q AS (SELECT p_partkey AS request_id, unnest(generate_series(1990, 1990 + p_partkey % 9)) AS fiscal_year, n_name AS company, 'revenue' AS metric FROM part JOIN nation ON n_nationkey = p_partkey % 25), g AS (SELECT request_id, count(*) AS required, count(f.company) AS available FROM q LEFT JOIN facts f USING (company, metric, fiscal_year) GROUP BY 1) SELECT request_id, required, available, CASE WHEN available = required THEN 'FULL' WHEN available > 0 THEN 'PARTIAL' ELSE 'NONE' END AS grade FROM g")
def j9_coverage(spark, sf):
    k = F.col("p_partkey")
    n = S.read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("company"))
    q = S.read(spark, sf, "part").join(n, F.col("n_nationkey") == k % 25).select(k.alias("request_id"), "company", F.lit("revenue").alias("metric"), F.explode(F.sequence(F.lit(1990), (1990 + k % 9).cast("int"))).alias("fiscal_year"))
    return facts.coverage(q, S.facts(spark, sf))


@query(f"WITH {FACTS}, g AS (SELECT n.company, n.metric, n.fiscal_year, round((CAST(n.value AS DOUBLE) - CAST(b.value AS DOUBLE)) / CAST(b.value AS DOUBLE) * 100, 6) AS growth FROM facts n JOIN facts b ON n.company = b.company AND n.metric = b.metric AND n.fiscal_year = b.fiscal_year + 1), m AS (SELECT *, max(growth) OVER (PARTITION BY metric, fiscal_year) AS best FROM g) SELECT metric, fiscal_year, min(company) AS leader, max(growth) AS growth FROM m WHERE abs(growth - best) <= 0.01 GROUP BY 1, 2 HAVING count(*) = 1")
def q13_growth_leader(spark, sf):
    return facts.growth_leader(facts.year_on_year(S.facts(spark, sf)))


@query(f"WITH {FACTS} SELECT a.company, b.company AS other, a.metric, a.fiscal_year, round(CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE), 4) AS difference, CASE WHEN b.value > 0 THEN round((CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)) / CAST(b.value AS DOUBLE) * 100, 2) END AS percent FROM facts a JOIN facts b ON a.metric = b.metric AND a.fiscal_year = b.fiscal_year AND a.company < b.company")
def y1_differences(spark, sf):
    return facts.differences(S.facts(spark, sf))


@query(f"WITH {FACTS} SELECT company, fiscal_year, metric FROM facts WHERE metric = 'revenue' AND fiscal_year BETWEEN 1993 AND 1995 ORDER BY company, fiscal_year")
def z1_find(spark, sf):
    return S.facts(spark, sf).where((F.col("metric") == "revenue") & F.col("fiscal_year").between(1993, 1995)).select("company", "fiscal_year", "metric").orderBy("company", "fiscal_year")


@query("SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 60 AND 90 AS full_period FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def f16_duration(spark, sf):
    j = S.read(spark, sf, "lineitem").join(S.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").between(60, 90).alias("full_period"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'FY' || (year(o_orderdate) - 1) ELSE 'Q' || quarter(o_orderdate) || '_FY' || (year(o_orderdate) - 1) END AS prior FROM orders")
def p4_prior_period(spark, sf):
    y = F.year("o_orderdate").cast("string")
    period = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("FY"), y)).otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit("_FY"), y))
    return S.read(spark, sf, "orders").select("o_orderkey", P.prior_period(period).alias("prior"))


@query("SELECT o_orderkey, 'Q' || quarter(o_orderdate) || '_' || year(o_orderdate) AS periods, 'Q' || quarter(o_orderdate) || '_' || year(o_orderdate) AS normal FROM orders")
def p1_quarters(spark, sf):
    text = F.concat(F.lit("results for q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" were good"))
    q = F.concat_ws(",", P.quarters(text))
    return S.read(spark, sf, "orders").select("o_orderkey", q.alias("periods"), P.normal_period(F.regexp_replace(q, "_", "-FY")).alias("normal"))


@query("WITH r AS (SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, 'again' FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'third' FROM documents WHERE doc_id % 30 = 0) SELECT doc_id AS id, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 1")
def d9_repeated_ids(spark, sf):
    """Ids that two records or more have, with their number: such a file is rejected."""
    d = S.documents(spark, sf).select("doc_id", "source")
    records = d.unionByName(d.where("doc_id % 10 = 0").withColumn("source", F.lit("again"))).unionByName(d.where("doc_id % 30 = 0").withColumn("source", F.lit("third")))
    return corpus.repeated_ids(records, "doc_id")


@query("SELECT user_id, CAST(min(n) AS BIGINT) AS first, CAST(max(n) AS BIGINT) AS last, count(*) AS size, event_type, island FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY n) AS island FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, event_type, island")
def g1_islands(spark, sf):
    i = corpus.islands(S.read(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    return i.select("user_id", "event_type", "island", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "size")


@query("WITH RECURSIVE n AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey > 1 THEN p_partkey // 4 + 1 END AS parent_id FROM part WHERE p_partkey = 1 OR p_partkey // 4 + 1 <> p_partkey), t AS (SELECT CAST(1 AS BIGINT) AS node_id, 0 AS depth, '1' AS path UNION ALL SELECT n.node_id, t.depth + 1, t.path || '/' || n.node_id FROM n JOIN t ON n.parent_id = t.node_id WHERE n.node_id <> 1) SELECT * FROM t")
def g2_descend(spark, sf):
    k = F.col("p_partkey")
    up = F.floor(k / 4) + 1
    nodes = S.read(spark, sf, "part").where((k > 1) & (up != k)).select(k.alias("node_id"), up.alias("parent_id"))
    return corpus.descend(nodes, spark.createDataFrame([(1,)], "node_id long"))
