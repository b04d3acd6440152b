"""Usage, billing, latency and task queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import corpus, usage
from evidara.plans.registry import query
from evidara.sources import tables as S

USAGE = "usage AS (SELECT event_id, user_id % 3 AS tenant_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS quantity, CASE WHEN event_type = 'purchase' THEN value * 0.01 END AS cost, ts AS created_at FROM events)"
TRACES = "traces AS (SELECT event_id AS trace_id, user_id % 3 AS tenant_id, user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END AS status, CASE WHEN event_type <> 'view' THEN value * 10 END AS duration_ms, ts AS started_at FROM events)"


@query(f"WITH {USAGE} SELECT event_type, count(event_id) AS events, CAST(sum(quantity) AS BIGINT) AS quantity FROM usage GROUP BY 1")
def a1_usage_by_type(spark, sf):
    return usage.by_type(S.usage(spark, sf))


@query(f"WITH {USAGE} SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, count(*) AS requests, CAST(sum(quantity) AS BIGINT) AS quantity, round(coalesce(sum(cost), 0), 4) AS cost FROM usage GROUP BY 1, 2")
def a2_monthly_usage(spark, sf):
    return usage.monthly(S.usage(spark, sf))


@query("WITH n AS (SELECT user_id, event_type AS tool, count(*) AS uses FROM events GROUP BY 1, 2) SELECT * FROM (SELECT user_id, tool, uses, CAST(row_number() OVER (PARTITION BY user_id ORDER BY uses DESC, tool) AS INTEGER) AS rank FROM n) WHERE rank <= 3")
def a3_top_tools(spark, sf):
    return usage.top_tools(S.read(spark, sf, "events").select("user_id", F.array("event_type").alias("tools")), 3)


AGENT = "SELECT tenant_id, count(*) AS total, count(*) FILTER (status = 'failed') AS failed, round(100.0 * count(*) FILTER (status = 'success') / nullif(count(*) FILTER (status IN ('success', 'failed')), 0), 2) AS success_rate, round(avg(duration_ms), 4) AS mean_ms FROM traces GROUP BY 1"


@query(f"WITH {TRACES} {AGENT}")
def a4_agent_metrics(spark, sf):
    return usage.agent_metrics(S.traces(spark, sf))


@query(f"WITH {TRACES} SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, round(avg(duration_ms), 4) AS mean_ms FROM traces GROUP BY 1")
def a5_daily_metrics(spark, sf):
    return usage.daily(S.traces(spark, sf))


@query(f"WITH {USAGE}, {TRACES}, m AS ({AGENT}), s AS (SELECT tenant_id, CAST(sum(quantity) AS BIGINT) AS quantity, round(coalesce(sum(cost), 0), 4) AS cost FROM usage GROUP BY 1) SELECT m.*, s.quantity, s.cost FROM m LEFT JOIN s USING (tenant_id)")
def a6_overview(spark, sf):
    return usage.overview(S.traces(spark, sf), S.usage(spark, sf))


@query(f"WITH {USAGE}, plans(tenant_id, monthly_limit) AS (VALUES (0, 1000), (1, 4000)), u AS (SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, count(*) AS used FROM usage GROUP BY 1, 2) SELECT tenant_id, month, used, greatest(coalesce(monthly_limit, 100) - used, 0) AS remaining, used < coalesce(monthly_limit, 100) AS allowed FROM u LEFT JOIN plans USING (tenant_id)")
def a7_quota(spark, sf):
    plans = spark.createDataFrame([(0, 1000), (1, 4000)], "tenant_id long, monthly_limit long")
    return usage.quota(S.usage(spark, sf), plans)


@query("SELECT event_id, round(CAST(value AS DOUBLE) / 1000 * 0.0015 + user_id / 1000.0 * 0.006 + (event_id % 4) * 0.001, 6) AS cost FROM events")
def a8_call_cost(spark, sf):
    return S.read(spark, sf, "events").select("event_id", usage.call_cost(F.col("value"), F.col("user_id"), F.col("event_id") % 4).alias("cost"))


@query(f"WITH {USAGE} SELECT user_id, event_type, CASE WHEN bool_and(cost IS NOT NULL) THEN round(sum(cost), 4) END AS cost FROM usage GROUP BY 1, 2")
def a9_summed_or_unknown(spark, sf):
    return S.usage(spark, sf).groupBy("user_id", "event_type").agg(F.round(usage.summed_or_unknown(F.col("cost").isNotNull(), F.col("cost")), 4).alias("cost"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def a10_percentiles(spark, sf):
    return usage.percentiles(S.read(spark, sf, "events"), "event_type", "value")


@query(f"WITH {TRACES} SELECT tenant_id, status, count(*) AS traces, round(min(duration_ms), 4) AS least, round(max(duration_ms), 4) AS most, round(quantile_cont(duration_ms, 0.5), 4) AS median, count(*) FILTER (duration_ms IS NULL) AS unknown FROM traces GROUP BY 1, 2")
def a11_scope_metrics(spark, sf):
    d = F.col("duration_ms")
    return S.traces(spark, sf).groupBy("tenant_id", "status").agg(F.count("*").alias("traces"), F.round(F.min(d), 4).alias("least"), F.round(F.max(d), 4).alias("most"), F.round(F.percentile(d, 0.5), 4).alias("median"), F.count_if(d.isNull()).alias("unknown"))


@query("SELECT toxic, count(*) AS cases, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, round(avg(quality), 6) AS mean FROM labels GROUP BY 1")
def a12_evaluate_batch(spark, sf):
    q = F.col("quality")
    return S.read(spark, sf, "labels").groupBy("toxic").agg(F.count("*").alias("cases"), F.count_if(q == 1).alias("passed"), F.count_if(q == 0).alias("failed"), F.round(F.avg(q), 6).alias("mean"))


@query("SELECT source, lang, count(*) AS documents FROM documents GROUP BY 1, 2")
def a19_count_by_document(spark, sf):
    return S.documents(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("documents"))


@query("SELECT doc_id % 3 AS tenant_id, count(DISTINCT source) AS companies, array_to_string(list_sort(list_distinct(list(source))), ',') AS names, count(*) AS documents FROM documents GROUP BY 1")
def a20_knowledge_overview(spark, sf):
    return S.documents(spark, sf).groupBy("tenant_id").agg(F.count_distinct("source").alias("companies"), F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("names"), F.count("*").alias("documents"))


@query("SELECT event_type AS name, user_id % 2 AS label, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def a22_metric_records(spark, sf):
    return S.read(spark, sf, "events").groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 2).alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"))


@query("WITH s AS (SELECT unnest(generate_series(0, (SELECT max(conv_id) + 5 FROM conversations))) AS conv_id) SELECT s.conv_id, count(c.turn) AS messages FROM s LEFT JOIN conversations c ON s.conv_id = c.conv_id GROUP BY 1")
def j1_message_counts(spark, sf):
    m = S.messages(spark, sf)
    last = m.agg(F.max("conv_id")).first()[0]
    all_ids = spark.range(0 if last is None else last + 6).withColumnRenamed("id", "conv_id")
    return usage.message_counts(all_ids, m)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')")
def j2_semi_join(spark, sf):
    returned = S.read(spark, sf, "orders").join(S.read(spark, sf, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return S.read(spark, sf, "customer").join(returned, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("WITH t AS (SELECT o_orderkey AS trace_id FROM orders), s AS (SELECT l_orderkey AS trace_id, l_linenumber AS span_id, l_shipdate AS started_at FROM lineitem) SELECT t.trace_id, CAST(count(s.span_id) AS INTEGER) AS spans, coalesce(string_agg(CAST(s.span_id AS VARCHAR), ',' ORDER BY s.started_at, s.span_id), '') AS span_ids FROM t LEFT JOIN s USING (trace_id) GROUP BY 1")
def j3_trace_spans(spark, sf):
    spans = S.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), F.col("l_shipdate").alias("started_at"))
    return usage.spans_of(S.read(spark, sf, "orders").select(F.col("o_orderkey").alias("trace_id")), spans)


@query("SELECT c_custkey, o_orderkey AS last_order FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j13_latest_of_each(spark, sf):
    last = S.read(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
    return S.read(spark, sf, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "last_order")


@query("SELECT o_orderkey, count(DISTINCT l_linenumber) AS stages, bool_and(l_linestatus = 'F') AS complete FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 0 GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 5")
def j14_three_way_check(spark, sf):
    o = S.dealt(S.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    # no semi join, which Spark would move to before the dealing; orders only have to be there, however often
    o = o.join(S.read(spark, sf, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    l = S.dealt(S.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_linestatus"), "o_orderkey")
    g = l.groupBy("o_orderkey").agg(F.count_distinct("l_linenumber").alias("stages"), F.every(F.col("l_linestatus") == "F").alias("complete")).where("stages >= 5")
    return g.join(o, "o_orderkey", "left_semi")


@query("SELECT conv_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3")
def r18_last_messages(spark, sf):
    return usage.last_messages(S.messages(spark, sf), 3)


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def r19_page(spark, sf):
    return usage.page(S.read(spark, sf, "events").select("event_id", "user_id", "ts"), [F.col("ts").desc(), F.col("event_id")], 40, 20)


@query("SELECT user_id, max(struct_pack(t := ts, i := event_id)).i AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1")
def r20_latest_checkpoint(spark, sf):
    return S.read(spark, sf, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(f"WITH {USAGE} SELECT event_id, tenant_id, user_id, row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, created_at, event_id) = 1 AS is_default FROM usage")
def r25_default_of_each_user(spark, sf):
    rank = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return usage.defaults_per_user(S.usage(spark, sf), rank).select("event_id", "tenant_id", "user_id", "is_default")


@query(f"WITH {TRACES} SELECT trace_id, status, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-15' - INTERVAL 30 MINUTE THEN 'pending' ELSE status END AS new_status FROM traces")
def w5_stale_tasks(spark, sf):
    return usage.stale(S.traces(spark, sf), F.lit("2024-01-15").cast("timestamp_ntz"), 30).select("trace_id", "status", "new_status")


@query("SELECT user_id, max(ts) AS last_seen, max(ts) < TIMESTAMP '2024-01-29' AS stale FROM events GROUP BY 1")
def w11_heartbeats(spark, sf):
    return S.read(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"), (F.max("ts") < F.lit("2024-01-29").cast("timestamp_ntz")).alias("stale"))


@query("SELECT event_id, least(60.0, pow(2.0, event_id % 9)) AS seconds FROM events")
def p10_backoff(spark, sf):
    return S.read(spark, sf, "events").select("event_id", usage.backoff_seconds(F.col("event_id") % 9).alias("seconds"))


@query("SELECT event_id, date_trunc('month', ts) AS month_start, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS TIMESTAMP) AS month_end, strftime(ts, '%Y-%m-%d') AS day FROM events")
def p9_calendar(spark, sf):
    start = F.date_trunc("month", "ts")
    return S.read(spark, sf, "events").select("event_id", start.cast("timestamp_ntz").alias("month_start"), F.add_months(start, 1).cast("timestamp_ntz").alias("month_end"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def m1_payload(spark, sf):
    return S.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, 'NEGATIVE' AS violation FROM events WHERE NOT coalesce(value >= 1, false) UNION ALL SELECT event_id, 'KIND' FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def f19_check_constraints(spark, sf):
    return corpus.violations(S.read(spark, sf, "events"), "event_id", {"NEGATIVE": F.col("value") >= 1, "KIND": F.col("event_type").isin("click", "view", "purchase")})


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND (event_type <> 'click' OR EXISTS (SELECT 1 FROM labels WHERE doc_id = event_id AND quality = 1))")
def f18_dispatchable(spark, sf):
    e = S.read(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    good = S.read(spark, sf, "labels").where("quality = 1")
    checked = e.where("event_type = 'click'").join(good, F.col("event_id") == F.col("doc_id"), "left_semi")
    return e.where("event_type <> 'click'").unionByName(checked).select("event_id", "event_type")


@query("SELECT doc_id, source FROM documents WHERE source ILIKE '%C1%' AND lang <> 'fr'")
def f20_ilike(spark, sf):
    return S.documents(spark, sf).where(F.col("source").ilike("%C1%") & (F.col("lang") != "fr")).select("doc_id", "source")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def f21_payload_equals(spark, sf):
    return S.read(spark, sf, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("SELECT count(*) AS rows, count(*) FILTER (user_id % 3 = 0) AS without_tenant, count(DISTINCT coalesce(nullif(user_id % 3, 0), 9)) AS tenants FROM events")
def z21_tenant_backfill(spark, sf):
    t = F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3)
    return S.read(spark, sf, "events").select(t.alias("t")).agg(F.count("*").alias("rows"), F.count_if(F.col("t").isNull()).alias("without_tenant"), F.count_distinct(F.coalesce("t", F.lit(9))).alias("tenants"))
