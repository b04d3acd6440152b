"""Labels, aliases, question modes and complexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import labels as L
from evidara.plans.grounding_queries import key, said
from evidara.plans.registry import query
from evidara.sources import tables as S

LABELS = [["Total  Revenue"], ["net income [注3]"], ["Other：items（net）"], ["EBITDA²"], ["nothing we know"], ["​Net Income(注1)"]]


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'TotalRevenue' WHEN 1 THEN 'netincome[注3]' WHEN 2 THEN 'Other:items(net)' WHEN 3 THEN 'EBITDA²' WHEN 4 THEN 'nothingweknow' ELSE 'NetIncome(注1)' END AS label, CASE o_orderkey % 6 WHEN 0 THEN 'totalrevenue' WHEN 1 THEN 'netincome' WHEN 2 THEN 'other:items(net)' WHEN 3 THEN 'ebitda' WHEN 4 THEN 'nothingweknow' ELSE 'netincome' END AS alias FROM orders")
def x14_row_label(spark, sf):
    return said(spark, sf, *LABELS).select("o_orderkey", L.row_label(F.col("text")).alias("label"), L.alias_key(F.col("text")).alias("alias"))


@query("SELECT o_orderkey AS row_id, CASE o_orderkey % 6 WHEN 0 THEN 'revenue' WHEN 1 THEN 'net_income' WHEN 5 THEN 'net_income' END AS metric, CASE o_orderkey % 6 WHEN 3 THEN 'AMBIGUOUS' WHEN 0 THEN 'EXACT' WHEN 1 THEN 'EXACT' WHEN 5 THEN 'EXACT' ELSE 'UNMAPPED' END AS status FROM orders")
def j11_alias_lookup(spark, sf):
    rows = said(spark, sf, *LABELS).select(F.col("o_orderkey").alias("row_id"), F.col("text").alias("label"))
    return L.alias_lookup(rows, spark.createDataFrame([("total revenue", "revenue"), ("Net Income", "net_income"), ("ebitda", "ebitda"), ("EBITDA", "operating_income")], "alias string, metric string"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'net_income' WHEN 1 THEN 'parent_income' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'UNMAPPED' ELSE 'UNMAPPED' END AS metric FROM orders")
def r24_longest_alias(spark, sf):
    s = said(spark, sf, ["What was Net Income?"], ["net income of the parent"], ["net income and revenue"], ["netincome"], ["who knows"])
    return s.select("o_orderkey", L.longest_alias(F.col("text"), {"net income": "net_income", "net income of the parent": "parent_income", "revenue": "revenue"}).alias("metric"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'compare' WHEN 1 THEN 'leader' WHEN 2 THEN 'risk' WHEN 3 THEN 'growth' WHEN 4 THEN 'investment' ELSE 'general' END AS mode FROM orders")
def q7_research_mode(spark, sf):
    s = said(spark, sf, ["A VS B and their risk"], ["who has the best growth"], ["name a Challenge to its future"], ["the future, and shall I buy"], ["shall I INVEST"], ["hello"])
    return s.select("o_orderkey", L.research_mode(F.col("text")).alias("mode"))


@query("SELECT o_orderkey, round(0.2 * CASE WHEN c + y <= 0 THEN 0.2 WHEN c + y <= 2 THEN 0.5 ELSE 0.8 END + 0.25 * CASE WHEN c = 0 THEN 0 WHEN c = 1 THEN 0.3 WHEN c = 2 THEN 0.6 ELSE 0.9 END + 0.15 * CASE WHEN y = 0 THEN 0 WHEN y = 1 THEN 0.3 WHEN y = 2 THEN 0.5 ELSE 0.8 END + 0.3 * CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 0.7 WHEN 2 THEN 1.0 ELSE 0.3 END + 0.1 * CASE WHEN c < 2 THEN 0 WHEN k = 1 THEN 0.8 ELSE 0.5 END, 4) AS score FROM (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey // 4 % 4 AS c, o_orderkey // 16 % 4 AS y FROM orders)")
def n18_complexity(spark, sf):
    k = key()
    task = F.when(k % 4 == 0, "CHAT").when(k % 4 == 1, "COMPARISON").when(k % 4 == 2, "RESEARCH").otherwise("SOMETHING")
    weights = {"prompt_length": 0.2, "company_count": 0.25, "year_count": 0.15, "task_weight": 0.3, "comparison": 0.1}
    return S.read(spark, sf, "orders").select("o_orderkey", L.complexity(task, F.floor(k / 4) % 4, F.floor(k / 16) % 4, weights).alias("score"))
