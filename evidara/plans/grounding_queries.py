"""Numbers and metrics in text, and lines against evidence. Sentences are built from orders, so the SQL knows what they say."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import grounding as G
from evidara.operators import corpus
from evidara.plans.registry import query
from evidara.sources import tables as S

def key():
    return F.col("o_orderkey")


def said(spark, sf, *cases):
    """o_orderkey and a sentence: the case with the number of the key's remainder."""
    text = F.lit(None).cast("string")
    for i, parts in enumerate(cases):
        text = F.when(key() % len(cases) == i, F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))).otherwise(text)
    return S.read(spark, sf, "orders").select("o_orderkey", text.alias("text"))


NUMBERS = """WITH k AS (SELECT o_orderkey, o_orderkey % 8 AS c, CAST(o_orderkey AS DOUBLE) AS k FROM orders)
SELECT o_orderkey, CASE c WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN k % 9000 + 1000 BETWEEN 1900 AND 2100 THEN 0 ELSE 1 END WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN CASE WHEN k % 50 < 10 THEN 0 ELSE 1 END WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS n,
CASE c WHEN 0 THEN (k % 900 + 100.5) * 1e6 WHEN 1 THEN CASE WHEN k % 9000 + 1000 BETWEEN 1900 AND 2100 THEN 0 ELSE -(k % 9000 + 1000) END WHEN 2 THEN 37.5 WHEN 4 THEN CASE WHEN k % 50 < 10 THEN 0 ELSE k % 50 END WHEN 5 THEN 3.5e8 WHEN 6 THEN (k % 800 + 100) * 1e3 ELSE 0 END AS total,
CASE c WHEN 0 THEN 'amount:usd' WHEN 1 THEN CASE WHEN k % 9000 + 1000 BETWEEN 1900 AND 2100 THEN '' ELSE 'amount:' END WHEN 2 THEN 'percent:,basis_points:' WHEN 4 THEN CASE WHEN k % 50 < 10 THEN '' ELSE 'amount:' END WHEN 5 THEN 'amount:usd' WHEN 6 THEN 'amount:' ELSE '' END AS kinds FROM k"""


@query(NUMBERS)
def n1_numbers(spark, sf):
    s = said(spark, sf, ["Revenue was $", key() % 900 + 100, ".5 million in 2024"], ["a loss of (", key() % 9000 + 1000, ") was booked"], ["margin of 12.5% (up 25 bps)"], ["[Evidence 15] and page 12 of 30x"], ["On April 26, 2026 we had ", key() % 50, " shops"], ["营收 3.5亿美元"], ["from ", key() % 800 + 100, " thousand to 7"], ["n/a"])
    n = s.select("o_orderkey", G.numbers("text").alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x["value"].cast("double"))
    return n.select("o_orderkey", F.size("n").alias("n"), total.alias("total"), F.concat_ws(",", F.transform("n", lambda x: F.concat(x["kind"], F.lit(":"), F.coalesce(x["currency"], F.lit(""))))).alias("kinds"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AND (o_orderkey % 4 <> 2) AS found FROM orders")
def n3_any_equivalent(spark, sf):
    """Billions with one decimal against millions: the same within half a tenth of a billion, but not in another currency."""
    million = (key() % 700 + 100) * 100 + F.when(key() % 3 == 0, 60).otherwise(40)
    s = S.read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("some $"), F.format_string("%.1f", ((key() % 700 + 100) * 100 / 1000.0)), F.lit(" billion and 3%")).alias("claim"), F.concat(F.when(key() % 4 == 2, "EUR ").otherwise("$"), million.cast("string"), F.lit(" million")).alias("evidence"))
    return s.select("o_orderkey", G.any_equivalent(G.numbers("claim"), G.numbers("evidence")).alias("found"))


DISPOSED = """WITH k AS (SELECT o_orderkey, o_orderkey % 500 + 200 AS now, o_orderkey % 90 + 150 AS before FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NON_NUMERIC' WHEN o_orderkey % 5 = 1 THEN 'SUPPORTED' WHEN o_orderkey % 5 = 2 THEN 'DERIVABLE' WHEN o_orderkey % 5 = 3 THEN CASE WHEN now = before AND false THEN 'DERIVABLE' ELSE 'UNSUPPORTED' END ELSE 'UNSUPPORTED' END AS disposition FROM k"""


@query(DISPOSED)
def y13_line_disposition(spark, sf):
    now, before = key() % 500 + 200, key() % 90 + 150
    rate = F.format_string("%.1f", (now - before) * 100.0 / before)
    more = F.format_string("%.1f", (now - before) * 100.0 / before + 5)
    evidence = F.concat(F.lit("$"), now.cast("string"), F.lit(" million against $"), before.cast("string"), F.lit(" million"))
    s = said(spark, sf, ["Sales were fine"], ["Sales were $", now, " million"], ["Sales changed by ", rate, "%"], ["Sales changed by ", more, "%"], ["Sales of $999 million changed by ", rate, "%"])
    return corpus.spread(s.withColumn("evidence", evidence)).select("o_orderkey", G.disposition(F.col("text"), G.numbers("evidence")).alias("disposition"))


@query("SELECT o_orderkey, o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 AND o_orderkey % 90 + 150 < o_orderkey % 500 + 200 AS supported FROM orders")
def n7_supports_derived(spark, sf):
    """Growth between two amounts of the evidence, or between those that a line itself puts in order; a fall must be called one."""
    now, before = key() % 500 + 200, key() % 90 + 150
    size = F.format_string("%.1f", F.abs((now - before) * 100.0 / before))
    line = F.when(key() % 4 == 0, F.concat(F.when(now < before, "down ").otherwise("up "), size, F.lit("%"))).when(key() % 4 == 1, F.concat(F.lit("up "), F.when(now > before, size).otherwise("777"), F.lit("%"))).when(key() % 4 == 2, F.concat(F.lit("moved "), F.lit("888%"))).otherwise(F.lit("no rate"))
    evidence = F.concat(now.cast("string"), F.lit(" million, then "), before.cast("string"), F.lit(" million"))
    s = S.read(spark, sf, "orders").select("o_orderkey", line.alias("line"), evidence.alias("evidence"))
    return corpus.spread(s).select("o_orderkey", G.supports_derived(G.numbers("line"), G.numbers("evidence"), F.col("line")).alias("supported"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'yoy:' || (o_orderkey % 40 + 1) || '.5' WHEN 1 THEN 'qoq:-' || (o_orderkey % 40 + 1) || '.5' WHEN 3 THEN 'yoy:' || (o_orderkey % 40 + 1) || '.0,qoq:-3.0' ELSE '' END AS rates FROM orders")
def n12_growth_rates(spark, sf):
    n = key() % 40 + 1
    far = " and a great deal of other things that have nothing to do with it at all "
    s = said(spark, sf, ["Sales rose ", n, ".5% year over year"], ["sales fell ", n, ".5% from the previous quarter"], ["sales were up ", n, "%"], ["Revenue grew ", n, "% YoY" + far + "but costs were down 3% sequentially"], ["up ", n, "% or 2 percentage points yoy"], ["up ", n, "%," + far + "year over year"])
    r = G.growth_rates("text")
    return s.select("o_orderkey", F.concat_ws(",", F.transform(r, lambda x: F.concat(x["basis"], F.lit(":"), F.format_string("%.1f", x["rate"])))).alias("rates"))


ASKED = [["What was total revenue?"], ["Data center revenue and net income"], ["Show the margins"], ["gross margin of the automotive segment: automotive gross margin"], ["revenue by segment, please"], ["Who is the chief executive?"]]
METRICS = "CASE {0} % 6 WHEN 0 THEN 'revenue' WHEN 1 THEN 'data_center_revenue,net_income' WHEN 2 THEN 'operating_margin,gross_margin' WHEN 3 THEN 'automotive_revenue,automotive_gross_margin' WHEN 4 THEN 'revenue,automotive_revenue,services_revenue,energy_revenue,data_center_revenue,edge_computing_revenue' ELSE '' END"


@query(f"SELECT o_orderkey, {METRICS.format('o_orderkey')} AS metrics FROM orders")
def n14_metrics(spark, sf):
    return said(spark, sf, *ASKED).select("o_orderkey", F.concat_ws(",", G.metrics("text")).alias("metrics"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN true ELSE coalesce(split_part({METRICS.format('o_orderkey')}, ',', 1) = CASE (o_orderkey // 6) % 3 WHEN 0 THEN 'revenue' WHEN 1 THEN 'data_center_revenue' ELSE 'none' END, false) END AS matches FROM orders")
def n15_metric_matches(spark, sf):
    part = F.floor(key() / 6) % 3
    evidence = F.when(part == 0, "Net sales were higher").when(part == 1, "DATA CENTER REVENUE was 3").otherwise("The weather")
    return said(spark, sf, *ASKED).select("o_orderkey", G.metric_matches("text", evidence).alias("matches"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'FY' || year(o_orderdate) END AS period, CASE WHEN o_orderkey % 6 = 0 THEN 'revenue' END AS metric FROM orders")
def n17_query_filters(spark, sf):
    s = said(spark, sf, *ASKED).join(S.read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("y")), "o_orderkey")
    periods = F.when(key() % 2 == 0, F.array(F.concat(F.lit("FY"), "y"))).otherwise(F.array(F.concat(F.lit("FY"), "y"), F.lit("FY1")))
    return s.select("o_orderkey", G.query_filters(periods, G.metrics("text")).alias("f")).select("o_orderkey", "f.period", "f.metric")
