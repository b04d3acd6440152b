"""Usage, cost, latency and quota reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_type(usage: DataFrame) -> DataFrame:
    return usage.groupBy("event_type").agg(F.count("event_id").alias("events"), F.sum("quantity").alias("quantity"))


def monthly(usage: DataFrame) -> DataFrame:
    """Requests, quantity and cost of each tenant and calendar month."""
    return usage.groupBy("tenant_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("requests"), F.sum("quantity").alias("quantity"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))


def daily(traces: DataFrame) -> DataFrame:
    """Counts by status and the mean of known durations for each calendar day."""
    status = [F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "running")]
    return traces.groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("total"), *status, F.round(F.avg("duration_ms"), 4).alias("mean_ms"))


def agent_metrics(traces: DataFrame) -> DataFrame:
    """For each tenant: counts, successes per cent of what ended, mean latency."""
    ended = F.count_if(F.col("status").isin("success", "failed"))
    return traces.groupBy("tenant_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.try_divide(F.count_if(F.col("status") == "success").cast("double"), ended.cast("double")) * 100, 2).alias("success_rate"),
        F.round(F.avg("duration_ms"), 4).alias("mean_ms"),
    )


def overview(traces: DataFrame, usage: DataFrame) -> DataFrame:
    """agent_metrics beside each tenant's quantity and cost."""
    spent = usage.groupBy("tenant_id").agg(F.sum("quantity").alias("quantity"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))
    return agent_metrics(traces).join(spent, "tenant_id", "left")


def top_tools(events: DataFrame, k: int = 5) -> DataFrame:
    """The k most used tools of each user; ties by name. tools: an array."""
    n = events.select("user_id", F.explode("tools").alias("tool")).groupBy("user_id", "tool").agg(F.count("*").alias("uses"))
    w = Window.partitionBy("user_id").orderBy(F.col("uses").desc(), F.col("tool"))
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quota(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Requests of each tenant and month against its plan's limit; without a plan the limit of 'free' holds."""
    used = usage.groupBy("tenant_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))
    limit = F.coalesce("monthly_limit", F.lit(100))
    return used.join(F.broadcast(plans), "tenant_id", "left").select("tenant_id", "month", "used", F.greatest(limit - F.col("used"), F.lit(0)).alias("remaining"), (F.col("used") < limit).alias("allowed"))


def call_cost(tokens_in: Column, tokens_out: Column, tools: Column) -> Column:
    """Fixed prices: 0.0015 and 0.006 for a thousand tokens in and out, 0.001 a tool call."""
    return F.round(tokens_in / 1000 * 0.0015 + tokens_out / 1000 * 0.006 + tools * 0.001, 6)


def summed_or_unknown(known: Column, value: Column) -> Column:
    """The sum, or null if any row is unknown."""
    return F.when(F.every(known), F.sum(value))


def percentiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact percentiles by linear interpolation, mean and extremes of each key."""
    points = [F.round(F.percentile(value, q), 4).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)]
    return df.groupBy(key).agg(*points, F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def message_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of every session, 0 included."""
    return sessions.join(messages, "conv_id", "left").groupBy("conv_id").agg(F.count("turn").alias("messages"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session, oldest first."""
    w = Window.partitionBy("conv_id")
    late = messages.withColumn("_back", F.row_number().over(w.orderBy(F.col("turn").desc()))).where(F.col("_back") <= n)
    return late.withColumn("position", F.row_number().over(w.orderBy("turn"))).drop("_back")


def spans_of(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Each trace's spans in order of their start: as many rows as traces; a trace's spans are few by nature."""
    own = spans.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("started_at", "span_id"))).alias("s"))
    return traces.join(own, "trace_id", "left").select("trace_id", F.coalesce(F.size("s"), F.lit(0)).alias("spans"), F.concat_ws(",", F.transform("s", lambda x: x["span_id"].cast("string"))).alias("span_ids"))


def stale(tasks: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Running tasks that began too long ago: they go back to pending."""
    late = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return tasks.withColumn("new_status", F.when(late, "pending").otherwise(F.col("status")))


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt))


def defaults_per_user(df: DataFrame, rank: Column) -> DataFrame:
    """Marks the first row of each tenant and user in the given order."""
    w = Window.partitionBy("tenant_id", "user_id").orderBy(rank, "created_at", "event_id")
    return df.withColumn("is_default", F.row_number().over(w) == 1)


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset(offset).limit(size)
