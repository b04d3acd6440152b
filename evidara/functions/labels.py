"""Row labels, aliases, question modes and complexity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Full-width and small forms that labels fold to plain ones, and marks without width that go.
WIDE, PLAIN = "：﹕（）［］", "::()[]"
WIDTHLESS = "​‌‍﻿"


def row_label(label: Column) -> Column:
    """A label without blanks and marks of no width, its brackets and colons plain. Other compatibility forms are left as they are."""
    return F.translate(F.regexp_replace(label, rf"[\s　 {WIDTHLESS}]+", ""), WIDE, PLAIN)


#: Fixed value: reference marks at the end of a label.
MARK = r"(?:\[(?:注)?\d+\]|\(注\d+\)|[¹²³⁴⁵⁶⁷⁸⁹])$"


def alias_key(label: Column) -> Column:
    """The key of a label: in lower case, without a reference mark at its end."""
    return F.regexp_replace(F.lower(row_label(label)), MARK, "")


def alias_lookup(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each row with the one metric that its label stands for: EXACT, AMBIGUOUS (several) or UNMAPPED. rows: row_id and label; aliases: alias
    and metric."""
    table = aliases.groupBy(alias_key(F.col("alias")).alias("_key")).agg(F.collect_set("metric").alias("_metrics"))
    found = rows.withColumn("_key", alias_key(F.col("label"))).join(table, "_key", "left")
    n = F.coalesce(F.size("_metrics"), F.lit(0))
    status = F.when(n == 1, "EXACT").when(n > 1, "AMBIGUOUS").otherwise("UNMAPPED")
    return found.select("row_id", F.when(n == 1, F.get("_metrics", 0)).alias("metric"), status.alias("status"))


def longest_alias(text: Column, aliases: dict[str, str]) -> Column:
    """The metric of the longest aliases that a text holds as whole words; an alias within a longer one that was found does not count,
    and several metrics are AMBIGUOUS."""
    t = F.lower(text)
    found = F.array_compact(F.array(*(F.when(t.rlike(rf"(?<![a-z0-9])\Q{a}\E(?![a-z0-9])"), F.struct(F.lit(a).alias("alias"), F.lit(m).alias("metric"))) for a, m in aliases.items())))
    alone = F.filter(found, lambda x: ~F.exists(found, lambda y: (F.length(y["alias"]) > F.length(x["alias"])) & F.contains(y["alias"], x["alias"])))
    metrics = F.array_distinct(F.transform(alone, lambda x: x["metric"]))
    return F.when(F.size(metrics) == 1, F.get(metrics, 0)).when(F.size(metrics) > 1, "AMBIGUOUS").otherwise("UNMAPPED")


#: The words of each research mode, in the order in which one is taken.
MODES = {
    "compare": ["compare", "comparison", "vs", "versus", "difference"],
    "leader": ["stronger", "leader", "leading", "best", "largest", "dominant", "moat"],
    "risk": ["risk", "challenge", "threat", "weakness"],
    "growth": ["growth", "future", "opportunity", "expand"],
    "investment": ["investment", "invest", "buy", "position", "outlook"],
}


def research_mode(question: Column, default: str = "general") -> Column:
    """The first mode of which a question holds a word."""
    q, out = F.lower(question), F.lit(default)
    for mode, words in reversed(MODES.items()):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w)), mode).otherwise(out)
    return out


#: What each kind of task weighs.
TASKS = {"CHAT": 0.0, "DOCUMENT_QA": 0.5, "SUMMARIZATION": 0.5, "OCR": 0.3, "IMAGE_ANALYSIS": 0.5, "COMPARISON": 0.7, "RESEARCH": 1.0, "FINANCIAL_ANALYSIS": 1.0, "CODE_GENERATION": 0.6, "UNKNOWN": 0.3}


def complexity(task: Column, companies: Column, years: Column, weights: dict[str, float]) -> Column:
    """The weighted sum of how much is asked: length, companies, years, the kind of task, and a comparison. weights: one for each."""
    steps = lambda n, *s: F.when(n <= 0, s[0]).when(n == 1, s[1]).when(n == 2, s[2]).otherwise(s[3])
    kind = F.coalesce(*(F.when(task == k, F.lit(v)) for k, v in TASKS.items()), F.lit(0.3))
    asked = companies + years
    factors = {
        "prompt_length": F.when(asked <= 0, 0.2).when(asked <= 2, 0.5).otherwise(0.8),
        "company_count": steps(companies, 0.0, 0.3, 0.6, 0.9),
        "year_count": steps(years, 0.0, 0.3, 0.5, 0.8),
        "task_weight": kind,
        "comparison": F.when(companies < 2, 0.0).when(task == "COMPARISON", 0.8).otherwise(0.5),
    }
    return F.round(sum((factors[k] * F.lit(w) for k, w in weights.items()), F.lit(0.0)), 4)
