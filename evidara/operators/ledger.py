"""The ledger of facts from evidence: typed rows where a piece of evidence has them, else numbers bound to metrics in its text; and the choice
among facts that claim the same figure."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import grounding as G
from evidara.functions.text import column
from evidara.operators.corpus import spread

#: Characters between a number and the metric it belongs to, at most.
REACH = 80
SENTENCE_END = r"(?<=[.;!?。；])\s+|\n+"
PERIOD = r"\b(?:Q[1-4]\s*(?:FY\s*)?|FY\s*)(?:19|20)\d{2}\b"
TYPED_ROW = "array<struct<metric:string,period:string,value:string,currency:string>>"


def alternation(aliases: dict[str, str]) -> str:
    """One pattern for all aliases, the longest first, so that a longer one wins where it begins."""
    return r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a))) + r")(?![\p{L}\p{N}])"


def period_key(found: Column) -> Column:
    """Q1_2024 or FY2024."""
    quarter, year = F.regexp_extract(found, r"(?i)(Q[1-4])", 1), F.regexp_extract(found, r"(\d{4})$", 1)
    return F.when(quarter != "", F.concat(F.upper(quarter), F.lit("_"), year)).otherwise(F.concat(F.lit("FY"), year))


def nearest(spans: Column, st: Column, en: Column, reach: int) -> Column:
    """Of spans that do not overlap st..en the nearest before it, within reach; if there is none, the nearest after it."""
    gap = lambda x: F.when(x["en"] <= st, st - x["en"]).when(x["st"] >= en, x["st"] - en)
    ranked = F.transform(spans, lambda x: F.struct((x["st"] >= en).alias("after"), gap(x).alias("gap"), x["st"].alias("st"), x["v"].alias("v")))
    return F.array_min(F.filter(ranked, lambda x: x["gap"].isNotNull() & (x["gap"] <= reach)))["v"]


def from_text(evidence: DataFrame, aliases: dict[str, str], reach: int = REACH) -> DataFrame:
    """evidence_id, company, metric, period, value, kind and currency of the numbers in evidence.text.

    A number belongs to the nearest alias before it in its sentence, else to the nearest after; its period is the nearest in the sentence, else the last that an earlier
    sentence named, else the evidence's own. Percentages next to a metric are facts of kind percent.
    """
    named = lambda x: F.transform(G.located(x, PERIOD), lambda p: F.struct(p["st"].alias("st"), p["en"].alias("en"), period_key(p["v"]).alias("v")))
    sentences = F.transform(F.split("text", SENTENCE_END), lambda x: F.struct(named(x).alias("periods"), x.alias("sentence")))
    # what earlier sentences named last goes from sentence to sentence within the row: nothing is sorted or moved
    start = F.struct(F.col("period").cast("string").alias("carried"), F.array().cast("array<struct<carried:string,periods:array<struct<st:int,en:int,v:string>>,sentence:string>>").alias("out"))

    def carry(state: Column, x: Column) -> Column:
        out = F.struct(state["carried"].alias("carried"), x["periods"].alias("periods"), x["sentence"].alias("sentence"))
        return F.struct(F.coalesce(F.try_element_at(x["periods"], F.lit(-1))["v"], state["carried"]).alias("carried"), F.concat(state["out"], F.array(out)).alias("out"))

    each = evidence.select("evidence_id", "company", F.explode(F.aggregate(sentences, start, carry, lambda state: state["out"])).alias("x")).select("evidence_id", "company", "x.*")
    # read once, behind the explode, not again wherever they are used
    read = F.struct(G.located("sentence", alternation(aliases)).alias("hits"), G.placed_numbers("sentence").alias("numbers"))
    each = each.select("evidence_id", "company", "carried", "periods", F.explode(F.array(read)).alias("x")).select("evidence_id", "company", "carried", "periods", "x.*")
    hits = each.where(F.size("hits") > 0)
    # the digits of a period are no number of their own
    outside = F.filter("numbers", lambda n: ~F.exists(F.col("periods"), lambda p: (n["st"] < p["en"]) & (n["en"] > p["st"])))
    numbers = hits.select("evidence_id", "company", "carried", "periods", "hits", F.explode(outside).alias("n"))
    key = F.lower(nearest(F.col("hits"), F.col("n.st"), F.col("n.en"), reach))
    found = numbers.withColumn("alias", key).where("alias IS NOT NULL")
    metric = F.create_map(*(F.lit(x) for a, m in aliases.items() for x in (a.lower(), m)))[F.col("alias")]
    period = F.coalesce(nearest(F.col("periods"), F.col("n.st"), F.col("n.en"), 1 << 20), F.col("carried"))
    return found.select("evidence_id", "company", metric.alias("metric"), period.alias("period"), F.col("n.value").alias("value"), F.col("n.kind").alias("kind"), F.col("n.currency").alias("currency"))


def usable(row: Column) -> Column:
    """A typed row that has a metric, a period and a number."""
    return row["metric"].isNotNull() & row["period"].isNotNull() & row["value"].try_cast(G.MONEY).isNotNull()


def from_rows(evidence: DataFrame) -> DataFrame:
    """The same columns from evidence.rows_json; rows without a metric, a period or a number are left out."""
    rows = evidence.select("evidence_id", "company", F.explode(F.from_json("rows_json", TYPED_ROW)).alias("r"))
    value = F.col("r.value").try_cast(G.MONEY)
    return rows.where(usable(F.col("r"))).select("evidence_id", "company", "r.metric", "r.period", value.alias("value"), F.lit("amount").alias("kind"), F.lower("r.currency").alias("currency"))


def from_evidence(evidence: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """All facts of the evidence, with the path they came by: typed rows first; the text of evidence that gave none."""
    evidence = spread(evidence)
    typed = from_rows(evidence.where("rows_json IS NOT NULL")).withColumn("path", F.lit("typed"))
    # whether a piece gave typed rows is read from the piece itself, so its text need not meet them
    rest = evidence.where(~F.coalesce(F.exists(F.from_json("rows_json", TYPED_ROW), usable), F.lit(False)))
    return typed.unionByName(from_text(rest, aliases).withColumn("path", F.lit("text")))


def settled(facts: DataFrame) -> DataFrame:
    """One row for each company, metric, period and kind: CONFLICT without a value where values differ, typed values overriding text."""
    # several values are there if the least is not the largest: no value is moved for that
    g = facts.groupBy("company", "metric", "period", "kind").agg(*(f(F.when(F.col("path") == p, F.col("value"))).alias(f"{p}_{f.__name__}") for p in ("typed", "text") for f in (F.min, F.max)), F.count("*").alias("mentions"))
    least, most = F.coalesce("typed_min", "text_min"), F.coalesce("typed_max", "text_max")
    return g.select("company", "metric", "period", "kind", "mentions", F.when(least < most, "CONFLICT").otherwise("OK").alias("status"), F.when(least == most, least).alias("value"))


#: Points of the choice among duplicates: inside the central cluster, off it, for each repetition up to a most, and for the period type.
NEAR_MEDIAN, END_OF_SPREAD, REPEATED, MOST_REPEATED, PERIOD_TYPE = 10, 12, 4, 20, 24
WIDE, CLUSTER = 1.5, 0.05


def preferred(facts: DataFrame, key: list[str], wants: Column | str, bonus: Column | int = 0) -> DataFrame:
    """The fact of each key with the highest score; then the surest, the largest and the last by id.

    facts: key, fact_id, value, period_type, confidence. wants: 'cumulative', 'quarter' or null, of the question. Where the largest value is
    WIDE times the smallest (and that is positive), the larger belongs to a cumulative question and the smaller to any other; else values
    close to the median (CLUSTER of the spread) gain. Values that are repeated gain, and so does the period type asked for.
    """
    wants, w = column(wants), Window.partitionBy(*key)
    v = F.col("value").cast("double")
    # the places are by value, so the middle of equal numbers of rows is the upper one, as of a sorted list
    placed = facts.withColumns({"_n": F.count("*").over(w), "_at": F.row_number().over(w.orderBy("value", "fact_id")) - 1, "_low": F.min(v).over(w), "_high": F.max(v).over(w), "_same": F.count("*").over(Window.partitionBy(*key, "value"))})
    placed = placed.withColumn("_median", F.max(F.when(F.col("_at") == F.floor(F.col("_n") / 2), v)).over(w))
    spread = F.greatest(F.col("_high") - F.col("_low"), F.lit(1.0))
    wide = (F.col("_low") > 0) & (F.col("_high") >= F.col("_low") * WIDE)
    target = F.when(wants == "cumulative", F.col("_high")).otherwise(F.col("_low"))
    by_value = F.when(wide, F.when(F.abs(v - target) < 1e-6, END_OF_SPREAD).otherwise(-END_OF_SPREAD)).otherwise(F.when(F.abs(v - F.col("_median")) <= spread * CLUSTER, NEAR_MEDIAN).otherwise(-NEAR_MEDIAN))
    repeated = F.least(F.col("_same") * REPEATED, F.lit(MOST_REPEATED))
    months, quarter = F.col("period_type").isin("six_months", "nine_months"), F.col("period_type") == "fiscal_quarter"
    sign = F.when(wants == "cumulative", 1).when(wants == "quarter", -1).otherwise(0)
    by_period = sign * F.when(months, PERIOD_TYPE).when(quarter, -PERIOD_TYPE).otherwise(0)
    alone = F.when(F.col("_n") >= 2, by_value + repeated).otherwise(0)
    scored = placed.withColumn("score", (alone + F.coalesce(by_period, F.lit(0)) + (bonus if isinstance(bonus, Column) else F.lit(bonus))).cast("long"))
    best = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.floor(F.col("confidence") * 1000).desc(), F.col("value").desc(), F.col("fact_id").desc())
    return scored.withColumn("_best", F.row_number().over(best)).where("_best = 1").select(*key, "fact_id", "value", "period_type", "score")
