"""Typed facts: eligibility, conflicts, lookups that fail closed, audits and derived figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import numbers as N


def rejections(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that cannot be decided counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def eligible(rows: DataFrame) -> DataFrame:
    """Reasons against each row as a fact, and whether it may be one."""
    rules = {
        "MISSING_COMPANY": F.col("company").isNotNull() & (F.col("company") != ""),
        "MISSING_VALUE": F.col("value").isNotNull(),
        "UNKNOWN_UNIT": N.unit_scale(F.col("unit")).isNotNull(),
        "MISSING_CURRENCY": F.col("currency").isNotNull(),
        "YEAR_OUT_OF_RANGE": F.col("fiscal_year").between(1900, 2100),
        "UNVERIFIED": F.col("verification_status") == "VERIFIED",
    }
    return rows.withColumn("reasons", rejections(rules)).withColumn("eligible", F.size("reasons") == 0)


def resolve_conflicts(rows: DataFrame, identity: list[str], value: str = "value") -> DataFrame:
    """One row for each identity: its status, number of rows and, where all agree, its value."""
    g = rows.groupBy(*identity).agg(F.count("*").alias("rows"), F.count_distinct(value).alias("values"), F.min(value).alias("lowest"))
    return g.select(*identity, "rows", F.when(F.col("values") > 1, "CONFLICT").otherwise("OK").alias("status"), F.when(F.col("values") == 1, F.col("lowest")).alias(value))


def save_batch(existing: DataFrame, incoming: DataFrame, identity: list[str]) -> DataFrame:
    """Each incoming row as inserted, unchanged or conflicted, against what is there and within the batch."""
    batch = resolve_conflicts(incoming, identity).withColumnsRenamed({"value": "new_value", "status": "batch_status"})
    known = existing.select(*identity, F.col("value").alias("old_value"))
    outcome = F.when(F.col("batch_status") == "CONFLICT", "conflicted").when(F.col("old_value").isNull(), "inserted").when(F.col("old_value") == F.col("new_value"), "unchanged").otherwise("conflicted")
    return batch.join(known, identity, "left").select(*identity, outcome.alias("outcome"))


def latest(facts: DataFrame) -> DataFrame:
    """The rows of the last year of each company and metric, ties kept."""
    w = Window.partitionBy("company", "metric").orderBy(F.col("fiscal_year").desc())
    return facts.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def lookup(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fail-closed: CONFLICT before NOT_FOUND before AMBIGUOUS before FOUND; only FOUND has a value.

    requests: request_id, company, metric, fiscal_year (null: any). resolved: as from resolve_conflicts.
    """
    r, f = requests.alias("r"), resolved.alias("f")
    same = (F.col("r.company") == F.col("f.company")) & (F.col("r.metric") == F.col("f.metric")) & (F.col("r.fiscal_year").isNull() | (F.col("r.fiscal_year") == F.col("f.fiscal_year")))
    g = r.join(f, same, "left").groupBy("r.request_id").agg(F.count("f.status").alias("matches"), F.count_if(F.col("f.status") == "CONFLICT").alias("conflicts"), F.min("f.value").alias("value"))
    status = F.when(F.col("conflicts") > 0, "CONFLICT").when(F.col("matches") == 0, "NOT_FOUND").when(F.col("matches") > 1, "AMBIGUOUS").otherwise("FOUND")
    return g.select("request_id", status.alias("status"), F.when(status == "FOUND", F.col("value")).alias("value"))


def identity_audit(facts: DataFrame, whole: str, parts: list[str], tolerance: str = "0.01") -> DataFrame:
    """Whether whole equals the sum of parts, for the groups that have all of them."""
    names = [whole, *parts]
    wide = facts.groupBy("company", "fiscal_year").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names))
    full = wide.where(" AND ".join(f"{m} IS NOT NULL" for m in names))
    gap = F.col(whole)
    for p in parts:
        gap = gap - F.col(p)
    return full.select("company", "fiscal_year", gap.cast("decimal(38,4)").alias("gap"), (F.abs(gap) <= F.lit(tolerance).cast("decimal(10,4)")).alias("balanced"))


def year_on_year(facts: DataFrame) -> DataFrame:
    """Growth of each fact against its prior comparable period, joined exactly one year back."""
    now, before = facts.alias("n"), facts.alias("b")
    same = (F.col("n.company") == F.col("b.company")) & (F.col("n.metric") == F.col("b.metric")) & (F.col("n.fiscal_year") == F.col("b.fiscal_year") + 1)
    return now.join(before, same).select("n.company", "n.metric", "n.fiscal_year", F.round(N.growth(F.col("n.value"), F.col("b.value")), 6).alias("growth"))


def growth_leader(growth: DataFrame) -> DataFrame:
    """The company that grew most in each metric and year, if it alone is within 0.01 of the best."""
    w = Window.partitionBy("metric", "fiscal_year")
    near = growth.withColumn("best", F.max("growth").over(w)).where(F.abs(F.col("growth") - F.col("best")) <= 0.01)
    return near.groupBy("metric", "fiscal_year").agg(F.count("*").alias("n"), F.min("company").alias("leader"), F.max("growth").alias("growth")).where("n = 1").drop("n")


def margins(facts: DataFrame, part: str, whole: str) -> DataFrame:
    wide = facts.groupBy("company", "fiscal_year").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in (part, whole)))
    return wide.select("company", "fiscal_year", F.round(N.margin(F.col(part), F.col(whole)), 6).alias("margin"))


def growth_over_years(facts: DataFrame) -> DataFrame:
    """Compound yearly growth from the first to the last year of each company and metric."""
    ends = facts.groupBy("company", "metric").agg(F.min_by("value", "fiscal_year").alias("first"), F.max_by("value", "fiscal_year").alias("last"), F.min("fiscal_year").alias("y0"), F.max("fiscal_year").alias("y1"))
    return ends.select("company", "metric", F.round(N.cagr(F.col("first"), F.col("last"), F.col("y1") - F.col("y0")), 8).alias("cagr"))


def differences(facts: DataFrame) -> DataFrame:
    """Differences of two companies in the same metric and year; per cent only against a positive base, half up."""
    a, b = facts.alias("a"), facts.alias("b")
    same = (F.col("a.metric") == F.col("b.metric")) & (F.col("a.fiscal_year") == F.col("b.fiscal_year")) & (F.col("a.company") < F.col("b.company"))
    gap = F.col("a.value").cast("double") - F.col("b.value").cast("double")
    share = F.when(F.col("b.value") > 0, F.round(gap / F.col("b.value").cast("double") * 100, 2))
    return a.join(b, same).select(F.col("a.company").alias("company"), F.col("b.company").alias("other"), "a.metric", "a.fiscal_year", F.round(gap, 4).alias("difference"), share.alias("percent"))


def coverage(required: DataFrame, facts: DataFrame) -> DataFrame:
    """How many of the facts that each question needs are there: FULL, PARTIAL or NONE."""
    have = facts.select("company", "metric", "fiscal_year").distinct().withColumn("there", F.lit(1))
    g = required.join(have, ["company", "metric", "fiscal_year"], "left").groupBy("request_id").agg(F.count("*").alias("required"), F.count("there").alias("available"))
    return g.select("request_id", "required", "available", F.when(F.col("available") == F.col("required"), "FULL").when(F.col("available") > 0, "PARTIAL").otherwise("NONE").alias("grade"))
