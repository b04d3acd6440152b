"""Retrieval and answer metrics over tables of ranked results and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_metrics(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at k in per cent. Queries that expect nothing score 100.

    ranked: query_id, rank, doc_id. expected: query_id, doc_id (nulls: nothing expected), each pair once. A repeated result
    counts in precision and gain, once in recall.
    """
    wanted = expected.where("doc_id IS NOT NULL").select("query_id", "doc_id", F.lit(1).alias("hit"))
    return metrics_of_hits(ranked.join(wanted, ["query_id", "doc_id"], "left"), expected.groupBy("query_id").agg(F.count("doc_id").alias("expected")), k)


def by_label(ranked: DataFrame, queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranked rows with hit (1 where the item has its query's label), and how many items each query expects.

    queries: query_id and label. items: doc_id and label. Labels are compared on ranked rows and counted once; no pairs are written out.
    """
    labelled = ranked.join(queries.withColumnRenamed("label", "asked"), "query_id").join(items, "doc_id", "left")
    sizes = items.groupBy("label").agg(F.count("*").alias("expected"))
    per = queries.join(sizes, "label", "left").select("query_id", F.coalesce("expected", F.lit(0)).alias("expected"))
    return labelled.withColumn("hit", F.when(F.col("label") == F.col("asked"), 1)).drop("label", "asked"), per


def metrics_of_hits(ranked: DataFrame, all_ids: DataFrame, k: int) -> DataFrame:
    """ranked_metrics of rows that are marked already. all_ids: query_id and expected, the number."""
    hits = ranked.where(F.col("rank") <= k)
    gain = F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = hits.groupBy("query_id").agg(F.count("*").alias("returned"), F.count("hit").alias("hits"), F.count_distinct(F.when(F.col("hit") == 1, F.col("doc_id"))).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("expected"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    full = all_ids.join(per, "query_id", "left")
    score = lambda x: F.round(F.when(F.col("expected") == 0, 100.0).otherwise(F.coalesce(x, F.lit(0.0)) * 100), 4)
    return full.select(
        "query_id",
        score(F.try_divide(F.col("hits").cast("double"), F.col("returned").cast("double"))).alias("precision"),
        score(F.try_divide(F.col("found").cast("double"), F.col("expected").cast("double"))).alias("recall"),
        score(F.try_divide(F.lit(1.0), F.col("first").cast("double"))).alias("mrr"),
        score(F.col("dcg") / ideal).alias("ndcg"),
    )


def recall_at(ranked: DataFrame, expected: DataFrame, ks: list[int]) -> DataFrame:
    """Mean recall over the queries that expect something, at several cuts at once."""
    wanted = expected.where("doc_id IS NOT NULL")
    return recall_of_hits(ranked.join(wanted.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left"), wanted.groupBy("query_id").agg(F.count("*").alias("expected")), ks)


def recall_of_hits(ranked: DataFrame, size: DataFrame, ks: list[int]) -> DataFrame:
    """recall_at of rows that are marked already. size: query_id and expected, the number."""
    size = size.where("expected > 0")
    found = ranked.where("hit = 1").groupBy("query_id").agg(*(F.count_distinct(F.when(F.col("rank") <= k, F.col("doc_id"))).alias(f"k{k}") for k in ks))
    per = size.join(found, "query_id", "left")
    return per.agg(F.count("*").alias("queries"), *(F.round(F.avg(F.coalesce(f"k{k}", F.lit(0)) / F.col("expected")) * 100, 4).alias(f"recall_{k}") for k in ks))


def set_f1(found: Column, expected: Column) -> Column:
    """F1 of two sets in per cent; 100 where nothing is expected."""
    both = F.size(F.array_intersect(found, expected)).cast("double")
    total = (F.size(F.array_distinct(found)) + F.size(F.array_distinct(expected))).cast("double")
    return F.when(F.size(expected) == 0, 100.0).otherwise(F.round(F.coalesce(F.try_divide(2 * both, total), F.lit(0.0)) * 100, 4))


def leaks(ranked: DataFrame, allowed: DataFrame) -> DataFrame:
    """Results that a query's tenant may not see: must be empty. allowed: query_id, doc_id."""
    return ranked.join(allowed, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id")


def answer_quality(answer: Column, criteria: Column) -> Column:
    """Mean of length, the share of criteria named and not being an excuse, in per cent."""
    length = F.least(F.length(answer) / 200, F.lit(1.0)) * 100
    named = F.try_divide(F.size(F.filter(criteria, lambda c: F.contains(F.lower(answer), F.lower(c)))).cast("double"), F.size(criteria).cast("double")) * 100
    excuse = F.when(F.lower(answer).rlike(r"\b(cannot|unable|sorry)\b"), 0.0).otherwise(100.0)
    return F.round((length + F.coalesce(named, F.lit(100.0)) + excuse) / 3, 4)


def overall(retrieval: Column, tools: Column, answer: Column, grounding: Column) -> Column:
    """Fixed weights of the four scores."""
    return F.round(0.25 * retrieval + 0.20 * tools + 0.35 * answer + 0.20 * grounding, 4)


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each query as improved, regressed or unchanged between two runs; without a counterpart it cannot be compared."""
    o, n = old.select("query_id", F.col("recall").alias("old")), new.select("query_id", F.col("recall").alias("new"))
    verdict = F.when(F.col("old").isNull() | F.col("new").isNull(), "UNCOMPARABLE").when(F.col("new") > F.col("old"), "IMPROVED").when(F.col("new") < F.col("old"), "REGRESSED").otherwise("UNCHANGED")
    return o.join(n, "query_id", "full_outer").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("queries"))


#: Words of a promise that no source gives.
MARKERS = ["guaranteed return", "risk-free", "insider information", "secret deal", "confidential source", "100% guaranteed", "perfect prediction"]


def hallucination(answer: Column, sources: Column, companies: Column) -> Column:
    """100 less 10 for each marker found; sources and a company that is named give 5 back each; from 0 to 100."""
    t = F.lower(answer)
    left = 100.0 - 10.0 * F.size(F.filter(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(t, m)))
    left = F.when(F.size(sources) > 0, F.least(left + 5, F.lit(100.0))).otherwise(left)
    left = F.when(F.exists(companies, lambda c: F.contains(t, F.lower(c))), F.least(left + 5, F.lit(100.0))).otherwise(left)
    return F.when(F.coalesce(F.trim(answer), F.lit("")) == "", 100.0).otherwise(F.round(F.greatest(left, F.lit(0.0)), 1))


def categorical_match(actual: Column, expected: Column) -> Column:
    """100 where nothing is expected or both say the same, whatever case and blanks; else 0."""
    same = F.lower(F.trim(actual)) == F.lower(F.trim(expected))
    return F.when(F.coalesce(expected, F.lit("")) == "", 100.0).when(F.coalesce(same, F.lit(False)), 100.0).otherwise(0.0)


def source_match(found: Column, expected: Column) -> Column:
    """F1 of source names in per cent, whatever case and blanks; null where no source is expected."""
    names = lambda a: F.array_distinct(F.filter(F.transform(a, lambda s: F.lower(F.trim(s))), lambda s: s != ""))
    got, want = names(found), names(expected)
    both = F.size(F.array_intersect(got, want)).cast("double")
    return F.when(F.size(want) > 0, F.round(200 * both / (F.size(got) + F.size(want)), 1))


def better_retriever(a: Column, b: Column) -> Column:
    """HYBRID (a), TREE (b) or TIE: first what has no wrong citation at all, then recall, then precision. Both: wrong (counts), recall, precision."""
    rank = lambda x: F.struct(F.forall(x["wrong"], lambda n: n == 0).alias("sound"), x["recall"].alias("recall"), x["precision"].alias("precision"))
    return F.when(rank(a) == rank(b), "TIE").when(rank(a) > rank(b), "HYBRID").otherwise("TREE")


def numbered(evidence: DataFrame, key: str, k: int) -> DataFrame:
    """The first k rows of each key in their place, numbered from 1."""
    w = Window.partitionBy(key).orderBy("place")
    return evidence.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def joined(rows: DataFrame, key: str, block: Column, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n").alias(name))


def head(*more: Column) -> Column:
    """The lines that name a piece of evidence."""
    return F.concat(F.lit("[Evidence "), F.col("rank").cast("string"), F.lit("]\nSource: "), "source", F.lit("\nChunk: "), F.col("chunk_id").cast("string"), F.lit("\n"), *more)


def context(evidence: DataFrame, key: str, k: int) -> DataFrame:
    """The evidence of each key as one text to answer from. evidence: source, chunk_id, text and place."""
    return joined(numbered(evidence, key, k), key, head(F.lit("\n\n"), F.col("text"), F.lit("\n")), "context")


def citations(evidence: DataFrame, key: str, k: int) -> DataFrame:
    """The references of each key, each with a preview of 150 characters. evidence: source, chunk_id, text, confidence and place."""
    return joined(numbered(evidence, key, k), key, head(F.lit("Confidence: "), F.col("confidence").cast("string"), F.lit("\n\nPreview:\n"), F.substring("text", 1, 150), F.lit("\n\n" + "-" * 60)), "citations")


def held_by_source(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence with whether its span is in the source block that it names, on the same page. Both: doc_id, block_id, page."""
    s = sources.select("doc_id", "block_id", F.col("page").alias("_page"), F.col("text").alias("_text"))
    ok = (F.col("page") == F.col("_page")) & (F.trim("words") != "") & F.contains(F.col("_text"), F.col("words"))
    return evidence.join(s, ["doc_id", "block_id"], "left").withColumn("held", F.coalesce(ok, F.lit(False))).drop("_page", "_text")


def coverage(required: DataFrame, found: DataFrame, key: str, on: list[str]) -> DataFrame:
    """FULL, PARTIAL or NONE for each key, and the share of what it requires that was found."""
    there = found.select(key, *on).distinct().withColumn("_there", F.lit(True))
    each = required.join(there, [key, *on], "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    grade = F.when(F.every("_there"), "FULL").when(F.some("_there"), "PARTIAL").otherwise("NONE")
    return each.groupBy(key).agg(grade.alias("coverage"), F.round(F.avg(F.col("_there").cast("double")), 6).alias("share"))


def benchmark_summary(runs: DataFrame, key: str, quality: str, latency: str) -> DataFrame:
    """Runs of each key, how many were scored, and means over those that have a value."""
    return runs.groupBy(key).agg(F.count("*").alias("n"), F.count(quality).alias("scored"), F.round(F.avg(quality), 4).alias("quality"), F.round(F.avg(latency), 4).alias("latency"))


def ranked_confidence(rows: DataFrame) -> DataFrame:
    """Rank of each row of a query, and its score as a confidence from 0 to 1."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return rows.select("query_id", "doc_id", F.round(F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)), 4).cast("double").alias("confidence"), F.row_number().over(w).alias("rank"))


def best_rejected(rows: DataFrame) -> DataFrame:
    """The most confident row, the first of equals, of each query of which no row was admitted."""
    best = F.max_by(F.struct("doc_id", "confidence"), F.struct("confidence", (-F.col("doc_id")).alias("first")))
    return rows.groupBy("query_id").agg(F.some("admitted").alias("any"), best.alias("best")).where("not any").select("query_id", "best.*")
