"""Reads and gates over repository tables: lookups, readiness, promotions, spans and averages of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_rank(channels: DataFrame) -> DataFrame:
    """Both rankings of a query side by side, as a full outer join on the key gives: vector_rank and lexical_rank."""
    rank = lambda c: F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank")
    return channels.groupBy("query_id", "key").agg(rank("vector"), rank("lexical"))


def judged_hits(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Each ranked row with whether it is expected. Both: query_id, doc_id."""
    return ranked.join(expected.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def eligible_rows(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of pages whose quality passed. rows: doc_id, page; pages: doc_id, page, passed."""
    return rows.join(pages.where("passed").select("doc_id", "page"), ["doc_id", "page"], "left_semi")


def promotion(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: a candidate is promoted if every case that passed still passes. Both: case_id and passed; a case without a counterpart is a
    regression."""
    o, n = old.select("case_id", F.col("passed").alias("before")), new.select("case_id", F.col("passed").alias("after"))
    worse = F.coalesce(F.col("before"), F.lit(True)) & ~F.coalesce(F.col("after"), F.lit(False)) | F.col("before").isNull()
    return o.join(n, "case_id", "full_outer").agg(F.count("*").alias("cases"), F.count_if(worse).alias("regressions"), (F.count_if(worse) == 0).alias("promote"))


def plan_of(tenants: DataFrame, subscriptions: DataFrame, limits: DataFrame) -> DataFrame:
    """Each tenant with its active plan (else 'free') and that plan's limit. limits has a row for each plan there is."""
    active = subscriptions.where("active").groupBy("tenant_id").agg(F.max("plan").alias("_plan"))
    named = tenants.join(active, "tenant_id", "left").withColumn("plan", F.coalesce("_plan", F.lit("free"))).drop("_plan")
    return named.join(limits, "plan", "left")


def ready(parts: DataFrame, stages: list[str]) -> DataFrame:
    """Documents that have a complete receipt of every stage. parts: document_id, stage, complete."""
    done = F.collect_set(F.when(F.col("complete"), F.col("stage")))
    wanted = F.array(*map(F.lit, stages))
    return parts.groupBy("document_id").agg((F.size(F.array_except(wanted, done)) == 0).alias("ready"), F.every("complete").alias("all_complete"))


def agreement(labels: DataFrame, observed: DataFrame, fields: list[str]) -> DataFrame:
    """Per field, the share of labelled cases (in per cent) whose observation says the same; no observation is a miss."""
    both = labels.alias("l").join(observed.alias("o"), "case_id", "left")
    same = [F.round(100 * F.avg(F.coalesce(F.col(f"l.{f}") == F.col(f"o.{f}"), F.lit(False)).cast("double")), 4).alias(f) for f in fields]
    return both.agg(F.count("*").alias("cases"), *same)


def stage_means(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Mean of each stage's score over the rows that have one, in per cent to one place; null where none has."""
    return rows.agg(*(F.round(100 * F.avg(F.col(f).cast("double")), 1).alias(f) for f in flags), *(F.count(f).alias(f"{f}_cases") for f in flags))


def record_usage(rows: DataFrame) -> DataFrame:
    """Usage rows as they are appended: those without a tenant are left out, a missing quantity is one."""
    return rows.where("tenant_id IS NOT NULL").withColumn("quantity", F.coalesce("quantity", F.lit(1).cast("long")))


def gate(checks: dict[str, Column]) -> Column:
    """Whether each check holds, and all of them; one that cannot be decided fails."""
    held = {k: F.coalesce(c, F.lit(False)) for k, c in checks.items()}
    every = F.lit(True)
    for c in held.values():
        every = every & c
    return F.struct(*(c.alias(k) for k, c in held.items()), every.alias("passed"))


def reachable(moves: dict[str, list[str]], now: Column, then: Column) -> Column:
    """Whether a state may follow another; the same state always may."""
    ok = now == then
    for a, after in moves.items():
        ok = ok | (now == a) & then.isin(after)
    return ok
