"""Text, conversation, safety and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidara.functions import periods as P
from evidara.functions import text as T
from evidara.operators import corpus
from evidara.plans.registry import query
from evidara.sources import files, versioned
from evidara.sources import tables as S
from evidara.streaming import limits, windows

W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(rf"SELECT doc_id, len({W}) AS n, sha256(array_to_string({W}, ' ')) AS digest FROM documents")
def x1_tokens(spark, sf):
    """The number of tokens of each text, and a digest of all of them."""
    t = T.tokens("text")
    return S.documents(spark, sf).select("doc_id", F.size(t).alias("n"), F.sha2(F.concat_ws(" ", t), 256).alias("digest"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '(\w)-\s*\n\s*(\w)', '\1\2', 'g'), '[^\S\n]+', ' ', 'g'), '\s*\n\s*', ' ', 'g'))) AS digest FROM documents")
def x2_clean(spark, sf):
    return S.documents(spark, sf).select("doc_id", F.sha2(T.clean("text"), 256).alias("digest"))


@query("WITH c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 100) / 800.0) AS BIGINT), 1) - 1)) AS chunk FROM documents), p AS (SELECT doc_id, chunk, substr(text, chunk * 800 + 1, 900) AS part FROM c) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, sha256(doc_id || ':' || chunk || ':' || part) AS chunk_id, length(part) AS n_chars FROM p")
def x3_chunks(spark, sf):
    return corpus.chunks(S.documents(spark, sf), 900, 100).drop("text")


@query("WITH c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil(length(text) / 900.0) AS BIGINT), 1) - 1)) AS chunk FROM documents), p AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, substr(text, chunk * 900 + 1, 900) AS part FROM c), k AS (SELECT *, lower(trim(regexp_replace(part, '\\s+', ' ', 'g'))) AS n FROM p) SELECT doc_id, chunk FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY doc_id, chunk) AS r FROM k WHERE length(n) >= 40) WHERE r = 1".replace("\\\\", "\\"))
def d4_chunk_dedup(spark, sf):
    return corpus.deduplicate(corpus.chunks(S.documents(spark, sf)), [F.col("doc_id"), F.col("chunk")]).select("doc_id", "chunk")


@query(r"WITH k AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) > 3) AS w FROM conversations) SELECT conv_id, turn, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS keyword FROM k")
def x12_keyword(spark, sf):
    return S.messages(spark, sf).select("conv_id", "turn", T.keyword("text").alias("keyword"))


@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) || '<|end|>' AS text FROM conversations GROUP BY 1")
def x23_chat_text(spark, sf):
    return corpus.chat_text(S.messages(spark, sf))


@query("WITH m AS (SELECT conv_id, turn, role, row_number() OVER w AS n, lag(role) OVER w AS b, lead(role) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, bool_and((CASE role WHEN 'system' THEN n = 1 WHEN 'user' THEN coalesce(b, 'system') IN ('system', 'assistant') WHEN 'assistant' THEN coalesce(b = 'user', false) ELSE false END) AND (a IS NOT NULL OR role = 'assistant')) AS valid, count(*) AS turns FROM m GROUP BY 1")
def x24_chat_shape(spark, sf):
    return corpus.chat_shape(S.messages(spark, sf))


def having(*classes: tuple[str, str]) -> str:
    return ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in classes)


#: Of a chain c of digit groups: from each group on, the longest run of whole groups that has 13 to 19 digits.
CARDS = r"list_transform(list_transform(range(1, len(regexp_split_to_array(c, '[ -]')) + 1), lambda i: list_filter(list_transform(range(i, i + 19), lambda j: array_to_string(list_slice(regexp_split_to_array(c, '[ -]'), i, j), '')), lambda x: length(x) BETWEEN 13 AND 19)[-1]), lambda x: x)"
LUHN = "v IS NOT NULL AND list_sum(list_transform(generate_series(1, length(v)), lambda i: CASE WHEN (length(v) - i) % 2 = 0 THEN CAST(v[i:i] AS INTEGER) ELSE CAST(v[i:i] AS INTEGER) * 2 - CASE WHEN CAST(v[i:i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
#: The classes as DuckDB's engine can say them: it has no looking around, so what stands beside a match is matched too.
SENSITIVE = having(
    ("private key", "contains(text, 'PRIVATE KEY-----') AND regexp_matches(text, '-----BEGIN ([A-Z ]+ )?PRIVATE KEY-----')"),
    ("cloud access key", r"regexp_matches(text, '\b(AKIA|ASIA)[[:upper:][:digit:]]{16}\b')"),
    ("GitHub token", r"regexp_matches(text, '\bgh(p|o|u|s|r)_\w{20,}\b')"),
    ("OpenAI-style API key", r"regexp_matches(text, '\bsk-[\w-]{16,}\b')"),
    ("credential assignment", r"regexp_matches(lower(text), '\b(api[_-]?key|secret|password|(access|auth)[_-]?token)\b\s*[:=]\s*[^\s<]\S{5,}')"),
    ("authorization header", r"regexp_matches(lower(text), '\bbearer\s+[[:alnum:]._~-]{12,}\b')"),
    ("email", r"contains(text, '@') AND regexp_matches(lower(text), '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z][a-z]+\b')"),
    ("us ssn", r"regexp_matches(text, '(^|\D)\d{3}-\d\d-\d{4}(\D|$)')"),
    ("cn id", "regexp_matches(text, '(^|[^[:alnum:]])[1-9][[:digit:]]{16}[[:digit:]xX]([^[:alnum:]]|$)')"),
    ("cn phone", r"regexp_matches(text, '(^|\D)1[3-9]\d{9}(\D|$)')"),
    ("international phone", r"contains(text, '+') AND regexp_matches(text, '(^|\W)\+\d{1,3}[ .-]?\d{3,4}[ .-]?\d{3,4}[ .-]?\d{3,4}(\W|$)')"),
    ("card", rf"regexp_matches(text, '\d(?:[ -]?\d){{12}}') AND len(list_filter(flatten(list_transform(regexp_extract_all(text, '\d+(?:[ -]\d+)*'), lambda c: {CARDS})), lambda v: {LUHN})) > 0"),
)


@query(f"SELECT doc_id, array_to_string(list_filter([{SENSITIVE}], lambda x: x IS NOT NULL), ',') AS classes FROM documents")
def x21_sensitive(spark, sf):
    docs = corpus.spread(S.documents(spark, sf).select("doc_id", "text"))
    return docs.select("doc_id", F.concat_ws(",", T.sensitive_classes("text")).alias("classes"))


@query("WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{13,19}')) AS v FROM documents) SELECT doc_id, v, list_sum(list_transform(generate_series(1, length(v)), lambda i: CASE WHEN (length(v) - i) % 2 = 0 THEN CAST(v[i:i] AS INTEGER) WHEN CAST(v[i:i] AS INTEGER) > 4 THEN CAST(v[i:i] AS INTEGER) * 2 - 9 ELSE CAST(v[i:i] AS INTEGER) * 2 END)) % 10 = 0 AS valid FROM d")
def x22_luhn(spark, sf):
    found = F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0)))
    return S.documents(spark, sf).select("doc_id", found.alias("v")).withColumn("valid", T.luhn_valid("v"))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) / nullif(CAST(length(regexp_replace(text, '\s+', '', 'g')) AS DOUBLE), 0), 6) AS share FROM documents")
def x25_alphanumeric_share(spark, sf):
    return S.documents(spark, sf).select("doc_id", F.round(T.alphanumeric_share("text"), 6).alias("share"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'column 1: ' ELSE 'flag: ' END || l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE ' | status: ' || l_linestatus END AS row_text FROM lineitem")
def s10_row_text(spark, sf):
    n = F.col("l_linenumber")
    headers = F.array(F.when(n % 3 == 0, " ").otherwise("flag"), F.lit("status"))
    values = F.array(F.col("l_returnflag"), F.when(n % 2 == 0, "  ").otherwise(F.col("l_linestatus")))
    return S.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.row_text(headers, values).alias("row_text"))


@query(r"WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(\w)-\s*\n\s*(\w)', '\1\2', 'g'), '[^\S\n]+', ' ', 'g'), '\s*\n\s*', ' ', 'g')) AS t FROM documents) SELECT doc_id, sha256(CASE WHEN length(t) > 4000 THEN substr(t, 1, 4000) || '...' ELSE t END) AS digest FROM c")
def s11_cell(spark, sf):
    return S.documents(spark, sf).select("doc_id", F.sha2(T.cell("text"), 256).alias("digest"))


@query("SELECT doc_id, text IS NOT NULL AS kept FROM documents WHERE doc_id % 3 IS NOT NULL ORDER BY doc_id")
def s14_lexical_corpus(spark, sf):
    return S.documents(spark, sf).where("tenant_id IS NOT NULL").select("doc_id", F.col("text").isNotNull().alias("kept")).orderBy("doc_id")


def changing(spark, name, rows):
    """An empty table of the rows' columns in the shared folder, parted by tenant."""
    return versioned.VersionedTable(spark, f"{corpus.shared_folder(spark)}/{name}-{uuid.uuid4().hex}", rows.schema, "tenant_id")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE lang END AS lang FROM documents UNION ALL SELECT doc_id + 1000000, 'new' FROM documents WHERE doc_id % 10 = 0")
def s13_upsert(spark, sf):
    """Chunks loaded, a tenth changed and as many added; every commit runs twice, the second time without effect."""
    d = S.documents(spark, sf).select("doc_id", "lang", "tenant_id")
    tenth = d.where("doc_id % 10 = 0").withColumn("lang", F.lit("new"))
    t = changing(spark, "chunks", d)
    for _ in range(2):
        t.upsert(d, ["doc_id"], "load")
        t.upsert(tenth.unionByName(tenth.withColumn("doc_id", F.col("doc_id") + 1_000_000)), ["doc_id"], "change")
    return t.read().select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents WHERE NOT (source = 'src3' AND doc_id % 3 = 1)")
def s15_delete(spark, sf):
    d = S.documents(spark, sf).select("doc_id", "source", "tenant_id")
    t = changing(spark, "chunks", d)
    t.upsert(d, ["doc_id"], "load")
    t.delete("source = 'src3' AND tenant_id = 1", "delete src3 of tenant 1")
    return t.read().select("doc_id", "source")


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id % 3 <> 2 GROUP BY 1")
def s16_delete_tenant(spark, sf):
    d = S.documents(spark, sf).select("doc_id", "source", "tenant_id")
    t = changing(spark, "chunks", d)
    t.upsert(d, ["doc_id"], "load")
    t.drop_partition(2, "drop tenant 2")
    return t.read().groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT doc_id % 3 AS tenant_id, sha256(source) AS source_sha256, sha256(text) AS artifact_sha256, octet_length(encode(text)) AS length FROM documents WHERE text IS NOT NULL")
def s18_artifacts(spark, sf):
    """Texts as blobs, put twice under their digests."""
    rows = S.documents(spark, sf).select("tenant_id", F.sha2("source", 256).alias("source_sha256"), F.col("text").cast("binary").alias("content"))
    t = versioned.VersionedTable(spark, f"{corpus.shared_folder(spark)}/artifacts-{uuid.uuid4().hex}", versioned.ARTIFACTS, "tenant_id")
    versioned.put_artifacts(t, rows, "first")
    versioned.put_artifacts(t, rows, "again")
    return t.read().select("tenant_id", "source_sha256", "artifact_sha256", F.octet_length("content").alias("length"))


@query("SELECT c_custkey % 40 AS file, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey) + 1 AS line, 'id: ' || c_custkey || ' | nation: ' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' | name: ' || CASE WHEN c_custkey % 7 = 0 THEN 'a, b; ' ELSE '' END || c_custkey END AS row_text, CAST(NULL AS VARCHAR) AS why FROM customer UNION ALL SELECT c_custkey % 40, count(*) + 2, NULL, '4 cells under 3 headers' FROM customer GROUP BY 1")
def s6_delimited(spark, sf):
    """Customers written as delimited files of four kinds, a bad last line in each, and read again."""
    c = S.read(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 40).alias("file"))
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit('"'), F.when(F.col("c_custkey") % 7 == 0, "a, b; ").otherwise(""), F.col("c_custkey"), F.lit('"')))
    mark = F.element_at(F.array(*(F.lit(x) for x in ",;\t|")), (F.col("file") % 4 + 1).cast("int"))
    lines = c.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.array_join(F.array(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), name), "\x01").alias("t")))).alias("rows"))
    body = F.concat(F.lit("id\x01nation\x01name\n"), F.array_join(F.transform("rows", lambda x: x["t"]), "\n"), F.lit("\n1\x012\x013\x014\n"))
    path = f"{corpus.shared_folder(spark)}/delimited-{uuid.uuid4().hex}"
    lines.select("file", F.replace(body, F.lit("\x01"), mark).alias("value")).repartition("file").write.partitionBy("file").text(path)
    found = files.load_files(spark, path).withColumn("suffix", F.lit("csv"))
    good, bad = files.delimited_rows(found)
    return good.select("path", "line", "row_text", F.lit(None).cast("string").alias("why")).unionByName(bad.select("path", "line", F.lit(None).cast("string").alias("row_text"), "why")).select(F.regexp_extract("path", r"file=([0-9]+)", 1).cast("long").alias("file"), "line", "row_text", "why")


@query("SELECT doc_id, lang, 'missing' AS side FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT doc_id, 'xx', 'extra' FROM documents WHERE doc_id % 50 = 0")
def y11_same_rows(spark, sf):
    d = S.documents(spark, sf).select("doc_id", "lang")
    return corpus.same_rows(d, d.withColumn("lang", F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("lang"))))


@query(r"WITH y AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\b((?:19|20)[0-9]{2})\b', 1)) AS y FROM documents) SELECT doc_id, CASE WHEN len(y) = 1 THEN CAST(y[1] AS INTEGER) END AS year FROM y")
def p11_explicit_year(spark, sf):
    return S.documents(spark, sf).select("doc_id", P.explicit_year("text").alias("year"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def w12_tumbling(spark, sf):
    return windows.tumbling(S.read(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) SELECT start, event_type, count(*) AS events FROM s GROUP BY 1, 2")
def w12_sliding(spark, sf):
    return windows.sliding(S.read(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, min(ts) AS start, CAST(max(ts) + INTERVAL 2 HOUR AS TIMESTAMP) AS \"end\", count(*) AS events FROM g GROUP BY user_id, s")
def w12_sessions(spark, sf):
    s = windows.sessions(S.read(spark, sf, "events"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query()
def w6_sliding_log(spark, sf):
    return limits.sliding_log(S.read(spark, sf, "events"), 3, 6 * 3600)


@query()
def w7_fixed_window(spark, sf):
    return limits.fixed_window(S.read(spark, sf, "events"), 5, 24 * 3600)


@query()
def w8_circuit_breaker(spark, sf):
    return limits.circuit_breaker(S.read(spark, sf, "events").withColumn("failed", F.col("event_type") == "error"), 2, 6 * 3600)
