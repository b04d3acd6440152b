"""Rules over facts, table rows, plans and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import rules
from evidara.plans.grounding_queries import key, said
from evidara.plans.registry import query
from evidara.sources import tables as S


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS conflict FROM orders")
def f5_period_conflict(spark, sf):
    s = said(spark, sf, ["Sales in Q1 2024 and Q2 2024"], ["Sales in Q2 2024 only"], ["no period at all"], ["none, but the row has one"], ["none, and the row has another"], ["Sales in Q1 FY2024"])
    row = F.when(key() % 6 == 3, "Q3_2023, Q1_2024").when(key() % 6 == 4, "Q3_2023|Q2_2024")
    return s.select("o_orderkey", rules.period_conflict(F.col("text"), row, F.lit("Q1-2024"), F.lit("Q1_2024")).alias("conflict"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'UNVERIFIED' WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN 'PARTIAL' ELSE 'VERIFIED' END AS status, (o_orderkey % 3 = 0)::INT + (o_orderkey % 4 = 0)::INT + (o_orderkey % 7 = 0)::INT + (o_orderkey % 11 = 0)::INT AS reasons FROM orders")
def f14_assess_row(spark, sf):
    k = key()
    o = S.read(spark, sf, "orders").select("o_orderkey", F.when(k % 3 != 0, "unit").alias("unit"), F.when(k % 4 == 0, " ").otherwise("usd").alias("currency"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("value"))
    a = rules.assess_row(["unit", "currency"], F.col("value"), F.lit("row text"), k % 7 != 0, k % 11 != 0)
    return o.select("o_orderkey", a.alias("a")).select("o_orderkey", "a.status", F.size("a.reasons").alias("reasons"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PARENT_COMPANY' ELSE 'CONSOLIDATED' END AS scope, CASE o_orderkey % 4 WHEN 0 THEN 'explicit_parent_company' WHEN 1 THEN 'explicit_consolidated' ELSE 'default_consolidated' END AS reason FROM orders")
def f17_report_scope(spark, sf):
    s = said(spark, sf, ["Net income of the Parent  Company"], ["CONSOLIDATED revenue"], ["revenue"], ["合并 revenue"])
    return s.select("o_orderkey", rules.report_scope(F.col("text")).alias("s")).select("o_orderkey", "s.scope", "s.reason")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2023,2024' WHEN 1 THEN '' WHEN 2 THEN '2025' WHEN 3 THEN '' ELSE '2021' END AS years FROM orders")
def z39_years(spark, sf):
    s = said(spark, sf, ["from 2023 to 2024, again 2023"], ["no year"], ["FY2025"], ["120245 and 1999"], ["年2021年"])
    return s.select("o_orderkey", F.array_join(rules.years_of(F.col("text")), ",").alias("years"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN o_orderkey % 2 = 0 WHEN 2 THEN o_orderkey % 3 = 0 WHEN 3 THEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 ELSE o_orderkey % 2 = 0 END AS bound FROM orders")
def p8_period_bound(spark, sf):
    s = said(spark, sf, ["how large is it"], ["what does the 2024 annual report say"], ["sales in 2023"], ["sales in 2023 by the FY2024 annual report"], ["2024年年报"])
    report, year = F.when(key() % 2 == 0, "FY2024").otherwise("2024"), F.when(key() % 3 == 0, "2023").otherwise("2022")
    return s.select("o_orderkey", rules.period_bound(F.col("text"), report, year).alias("bound"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS matches FROM nation")
def z4_company_matches(spark, sf):
    k = F.col("n_nationkey")
    asked = F.when(k % 4 == 0, F.concat(F.lit("c"), k.cast("string"))).when(k % 4 == 1, F.lower(F.substring("n_name", 1, 4))).when(k % 4 == 2, F.concat("n_name", F.lit(" Holding"))).otherwise(F.substring("n_name", 1, 2))
    return S.read(spark, sf, "nation").select("n_nationkey", rules.company_matches(asked, F.concat(F.lit("c"), k.cast("string")), F.col("n_name")).alias("matches"))


@query("WITH c AS (SELECT s_suppkey, lower(s_name) AS title, 's' || s_suppkey AS ticker FROM supplier), q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN 's' || s_suppkey WHEN 1 THEN lower(s_name) WHEN 2 THEN 'supplier' ELSE right(s_name, 6) END AS name FROM supplier WHERE s_suppkey <= 40), h AS (SELECT query_id, s_name AS title, CASE WHEN name = ticker THEN 100 WHEN name = c.title THEN 90 WHEN starts_with(c.title, name) THEN 80 WHEN contains(c.title, name) THEN 70 WHEN contains(ticker, name) THEN 60 END AS score FROM c JOIN supplier USING (s_suppkey), q), b AS (SELECT query_id, max(score) AS score FROM h GROUP BY 1) SELECT query_id, min(title) AS title, score FROM h JOIN b USING (query_id, score) GROUP BY query_id, score HAVING count(DISTINCT title) = 1")
def z5_lookup_company(spark, sf):
    s = S.read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("S"), k.cast("string"))).when(k % 4 == 1, F.col("s_name")).when(k % 4 == 2, "Supplier").otherwise(F.expr("right(s_name, 6)"))
    asked = s.where("s_suppkey <= 40").select(k.alias("query_id"), name.alias("name"))
    return rules.lookup_company(asked, s.select(F.col("s_name").alias("title"), F.concat(F.lit("s"), k.cast("string")).alias("ticker")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'UNKNOWN' WHEN o_orderkey % 3 = 0 THEN 'SATISFIED' WHEN o_orderkey % 3 = 1 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS grade, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 2 END + CASE WHEN o_orderkey % 6 = 5 THEN 1 ELSE 0 END AS missing FROM orders")
def g3_aspect_coverage(spark, sf):
    k, names = key(), lambda *x: F.array(*map(F.lit, x))
    required = F.when(k % 6 == 5, names("sales", "risk", "moon")).otherwise(names("sales", "risk"))
    covered = F.when(k % 3 == 0, names("risk", "sales", "other")).when(k % 3 == 1, names("risk")).otherwise(names("other"))
    c = rules.aspect_coverage(required, covered, names("sales", "risk", "other"))
    return S.read(spark, sf, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.grade", F.size("c.missing").alias("missing"))


@query("SELECT doc_id AS document_id, (doc_id % 3 = 2)::INT + (doc_id % 5 = 1)::INT + (doc_id % 7 = 1)::INT AS regressions, doc_id % 3 <> 2 AND doc_id % 5 <> 1 AND doc_id % 7 <> 1 AS promote FROM documents")
def g7_compare_policies(spark, sf):
    d, k = S.documents(spark, sf), F.col("doc_id")
    base = d.select(k.alias("document_id"), F.lit("READY").alias("state"), F.lit(2).alias("critical_orphans"), F.lit(0).alias("unexplained_dropped_blocks"), F.lit(0).alias("recovery_provenance_loss"))
    new = d.select(k.alias("document_id"), F.when(k % 3 == 2, "FAILED").otherwise("READY").alias("state"), (2 + (k % 5 == 1).cast("int") - (k % 5 == 2).cast("int")).alias("critical_orphans"), (k % 7 == 1).cast("int").alias("unexplained_dropped_blocks"), F.lit(0).alias("recovery_provenance_loss"))
    return rules.compare_policies(base, new).select("document_id", F.size("regressions").alias("regressions"), "promote")


@query("SELECT o_orderkey FROM orders JOIN documents ON doc_id = o_orderkey WHERE o_custkey % 3 = doc_id % 3")
def j6_same_owner(spark, sf):
    facts = S.read(spark, sf, "orders").select("o_orderkey", key().alias("document_id"), (F.col("o_custkey") % 3).alias("tenant_id"))
    return rules.same_owner(facts, S.documents(spark, sf).select(F.col("doc_id").alias("document_id"), "tenant_id")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 0 AS required, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END, l_linenumber * 1000000 + l_partkey) AS INTEGER) AS place FROM lineitem")
def j7_required_first(spark, sf):
    items = S.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("chunk_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("at"))
    required = items.where("chunk_id % 3 = 0").select("l_orderkey", "chunk_id")
    return rules.required_first(items, required, "l_orderkey", "at").select("l_orderkey", "l_linenumber", "required", "place")


@query("WITH RECURSIVE l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n, CAST(l_quantity AS BIGINT) AS c FROM lineitem), f AS (SELECT l_orderkey, n, c, CASE WHEN c <= 60 THEN 60 - c ELSE 60 END AS rest, c <= 60 AS fits FROM l WHERE n = 1 UNION ALL SELECT l.l_orderkey, l.n, l.c, CASE WHEN l.c <= f.rest THEN f.rest - l.c ELSE f.rest END, l.c <= f.rest FROM f JOIN l ON l.l_orderkey = f.l_orderkey AND l.n = f.n + 1) SELECT l_orderkey, count(*) FILTER (fits) AS taken, CAST(sum(CASE WHEN fits THEN c ELSE 0 END) AS BIGINT) AS cost FROM f GROUP BY 1")
def x28_context_budget(spark, sf):
    """Evidence in order as long as it fits what is left: a piece that is too long is passed over, later ones may fit."""
    l = S.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("c")))), lambda x: x["c"]).alias("costs"))
    kept = F.filter(F.arrays_zip(F.col("costs").alias("c"), rules.within_budget(F.col("costs"), 60).alias("fits")), lambda x: x["fits"])
    return l.select("l_orderkey", F.size(kept).cast("long").alias("taken"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("cost"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN true WHEN o_orderkey % 4 = 2 THEN o_orderkey % 3 = 0 ELSE false END AS met FROM orders")
def j12_dependencies(spark, sf):
    k = key()
    needs = F.when(k % 4 == 0, None).when(k % 4 == 1, F.array(F.lit(1))).when(k % 4 == 2, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(9)))
    done = F.when(k % 3 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))
    return S.read(spark, sf, "orders").select("o_orderkey", rules.dependencies_met(needs, done).alias("met"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber AS k, l_returnflag AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag)), s AS (SELECT l_orderkey, k, r, row_number() OVER (PARTITION BY l_orderkey, d ORDER BY r) AS within, CASE d WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS slot FROM l), o AS (SELECT l_orderkey, k, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN within = 1 THEN coalesce(slot, 9) ELSE 9 END, r) AS place FROM s) SELECT l_orderkey, string_agg(k, ',' ORDER BY place) AS keys FROM o WHERE place <= 3 GROUP BY 1")
def r12_reserved_slots(spark, sf):
    once = S.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_quantity", "l_returnflag"), F.struct("l_partkey", "l_quantity", "l_returnflag")).alias("x"))
    c = once.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("x.l_quantity")).alias("q"), "l_linenumber", F.col("x.l_returnflag").alias("f")))), lambda r: F.struct(r["l_linenumber"].cast("long").alias("key"), F.array(r["f"]).alias("dimensions"))).alias("scored"))
    return c.select("l_orderkey", F.array_join(rules.reserve_slots(F.col("scored"), F.array(F.lit("R"), F.lit("A")), 3).cast("array<string>"), ",").alias("keys"))


def boxes(spark, sf):
    """The lines of an order as rectangles on whole numbers."""
    x, y = F.col("l_linenumber").cast("double"), (F.col("l_partkey") % 5).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + F.col("l_suppkey") % 3).alias("x1"), (y + F.col("l_quantity") % 4).cast("double").alias("y1"))
    return S.read(spark, sf, "lineitem").select("l_orderkey", box.alias("box"))


@query("SELECT l_orderkey, CAST(count(DISTINCT (x, y)) AS DOUBLE) AS area FROM (SELECT l_orderkey, unnest(range(l_linenumber, l_linenumber + CAST(l_suppkey % 3 AS BIGINT))) AS x, y0, h FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, CAST(l_partkey % 5 AS BIGINT) AS y0, CAST(l_quantity AS BIGINT) % 4 AS h FROM lineitem)) t, LATERAL (SELECT unnest(range(t.y0, t.y0 + t.h)) AS y) GROUP BY 1")
def a27_union_area(spark, sf):
    """Orders that cover something; on whole numbers the area is the number of unit squares covered."""
    a = boxes(spark, sf).groupBy("l_orderkey").agg(F.collect_list("box").alias("b")).select("l_orderkey", rules.union_area(F.col("b")).alias("area"))
    return a.where("area > 0")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 3 = 0 OR CAST(l_quantity AS BIGINT) % 4 = 0 THEN 0.0 ELSE greatest(least(l_linenumber + l_suppkey % 3, 4) - greatest(l_linenumber, 2), 0) * greatest(least(l_partkey % 5 + CAST(l_quantity AS BIGINT) % 4, 5) - greatest(l_partkey % 5, 1), 0) / ((l_suppkey % 3) * (CAST(l_quantity AS BIGINT) % 4)) END AS share FROM lineitem")
def x33_overlap(spark, sf):
    x, y = F.col("l_linenumber").cast("double"), (F.col("l_partkey") % 5).cast("double")
    a = F.struct(x.alias("x0"), y.alias("y0"), (x + F.col("l_suppkey") % 3).alias("x1"), (y + F.col("l_quantity") % 4).cast("double").alias("y1"))
    b = F.struct(F.lit(2.0).alias("x0"), F.lit(1.0).alias("y0"), F.lit(4.0).alias("x1"), F.lit(5.0).alias("y1"))
    return S.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.overlap_share(a, b).alias("share"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS weaker FROM orders WHERE o_orderstatus = 'F' AND (quarter(o_orderdate) = 1 AND year(o_orderdate) = 1994 OR o_orderkey % 50 = 0)")
def n19_ledger_lookup(spark, sf):
    o = S.read(spark, sf, "orders")
    period = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit("-FY"), F.year("o_orderdate").cast("string"))
    facts = o.select("o_orderkey", F.col("o_orderstatus").alias("metric_id"), period.alias("fact_period"), F.when(key() % 50 == 0, "q1_1994").alias("table_column_period"), F.when(key() % 3 == 0, "FINANCIAL_STATEMENT").otherwise("TEXT").alias("source_kind"))
    return rules.ledger_lookup(facts, period="Q1_1994", metric_id="F", company=None).select("o_orderkey", "weaker")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 2 END AS n, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderstatus END AS label, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) + 1 END AS total FROM orders")
def m2_rows_from_json(spark, sf):
    rows = F.to_json(F.array(F.struct(F.col("o_orderstatus").alias("label"), F.col("o_totalprice").cast("double").alias("value")), F.struct(F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("value"))))
    text = F.when(key() % 4 == 3, "no json").otherwise(rows)
    r = S.read(spark, sf, "orders").select("o_orderkey", rules.rows_from_json(text, "struct<label:string,value:double>").alias("r"))
    total = F.when(F.size("r") > 0, F.aggregate("r", F.lit(0.0), lambda a, x: a + x["value"]))
    return r.select("o_orderkey", F.size("r").alias("n"), F.get("r", 0)["label"].alias("label"), total.alias("total"))
