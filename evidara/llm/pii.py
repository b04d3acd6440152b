"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

Base spans seed the search. The words before and after a seed are lexical patterns; every identifier-like token (and every seed) is an
instance. Pattern and instance are scored in turn: a pattern is worth the share of its places that hold a seed or a promoted
instance, against those that hold no identifier at all; an instance is worth what its patterns make of it, and is promoted above
a confidence. Promoted instances are support like seeds, until no round promotes more. Instances beside trusted patterns are
added. Only DataFrame functions run; regular expressions are possessive, so that no text makes them recurse or start over.

Rules for odd input: a null text is empty and has no spans; repeated rows are searched each on its own and counted in the
shares, but a pattern needs different instances; an empty table gives an empty result; other columns are ignored, or kept by redact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import materialise, row_of, spread

#: Base kinds in their fixed order, and the kind of what the method adds.
KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
#: The base patterns, written so that each match starts where a run starts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    FOUND: r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z@._+-]*+[0-9]|[@._+-]*+[A-Za-z]++[@._+-]++[A-Za-z])[A-Za-z0-9@._+-]{4,}+",
}
#: A letter that a text must hold to be searched at all.
NEEDS = {"email": "@", "phone": "+"}
#: Code points of context on each side, what makes a pattern trusted, and the confidence that promotes an instance.
CONTEXT, LEAST_SEEDS, LEAST_TRUST, LEAST_SURE = 40, 5, 0.8, 0.8
#: Patterns that every task may have, about 8 MB of hashes.
MOST_SENT = 200_000
WORDS = r"\p{L}++"
SPAN = "struct<st:int,en:int,v:string>"


def empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def add_spans(df: DataFrame, kind: str) -> DataFrame:
    """A column named after the kind with every match: first and one past the last code point, and the text of it."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    if kind in NEEDS:
        matches = F.when(F.contains(F.col("text"), F.lit(NEEDS[kind])), matches).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_m", matches).withColumn("_s", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    begin = F.struct(F.lit(0).alias("at"), empty().alias("out"))

    def go_on(acc: Column, i: Column) -> Column:
        st = acc["at"] + F.length(F.get("_s", i))
        en = st + F.length(F.get("_m", i))
        return F.struct(en.alias("at"), F.concat(acc["out"], F.array(F.struct(st.alias("st"), en.alias("en"), F.get("_m", i).alias("v")))).alias("out"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size("_m") - 1), begin, go_on, lambda acc: acc["out"])
    return df.withColumn(kind, F.when(F.size("_m") > 0, spans).otherwise(empty())).drop("_m", "_s")


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of v pass Luhn's check: from the right, every second digit counts double."""
    d = F.reverse(digits(v))
    doubled = lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: doubled(F.substring(d, i, F.lit(1)).cast("int"), i - 1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    n = F.length(digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0")))).cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return n.between(14, 19) & luhn(v)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def passes(kind: str) -> Callable[[Column], Column]:
    return lambda s: valid(kind, s["v"])


def fails(kind: str) -> Callable[[Column], Column]:
    return lambda s: ~valid(kind, s["v"])


def ranked(kind: str) -> Callable[[Column], Column]:
    """A span with the place of its kind in the fixed order."""
    return lambda s: F.struct(s["st"].alias("st"), F.lit(KINDS.index(kind)).alias("rank"), s["en"].alias("en"), F.lit(kind).alias("kind"), s["v"].alias("v"))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def contexts(st: Column, en: Column) -> Column:
    """The last word before a place and the last two, the first word after it and the first two, in lower case, as patterns.

    Words that reach beyond CONTEXT are left out: a part of a word would be a pattern that stands nowhere.
    """
    text, reach = F.col("text"), F.lit(CONTEXT + 1)
    before = F.substring(text, F.greatest(st - reach, F.lit(0)) + 1, F.least(st, reach))
    before = F.when(st > CONTEXT, F.regexp_replace(before, r"^\p{L}++", "")).otherwise(before)
    after = F.substring(text, en + 1, reach)
    after = F.when(F.length(after) > CONTEXT, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)

    def sided(mark: str, part: Column, start: int) -> Column:
        words = F.regexp_extract_all(F.lower(part), F.lit(WORDS), F.lit(0))
        n = F.size(words)
        # slices start at an existing word: of one word, there is no pattern of two
        one, two = F.concat(F.lit(mark), F.element_at(words, -1 if start < 0 else 1)), F.concat(F.lit(mark), F.concat_ws(" ", F.slice(words, start, 2)))
        return F.when(n >= 2, F.array(one, two)).when(n == 1, F.array(one)).otherwise(F.array().cast("array<string>"))

    return F.concat(sided("<", before, -2), sided(">", after, 1))


def add_base(docs: DataFrame, *keep: str) -> DataFrame:
    """row (the kept columns), the text, the base spans, and what looks like one and fails its check."""
    df = spread(docs).select(row_of(docs, keep).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        df = add_spans(df, kind)
    df = df.withColumn("failed", F.concat(*(F.filter(kind, fails(kind)) for kind in KINDS[1:])))
    for kind in KINDS[1:]:
        df = df.withColumn(kind, F.filter(kind, passes(kind)))
    base = F.concat(*(F.transform(kind, ranked(kind)) for kind in KINDS))
    return df.withColumn("base", F.array_sort(base)).drop(*KINDS)


def extract(docs: DataFrame, *keep: str) -> DataFrame:
    """row (the kept columns), a number for each row, the base spans, and the instances with their patterns. Written out."""
    df = add_spans(add_base(docs, *keep), FOUND)
    # what looks like a base kind and fails its check is no identifier either
    meets = lambda spans, s: F.exists(spans, lambda b: (b["st"] < s["en"]) & (s["st"] < b["en"]))
    apart = F.filter(FOUND, lambda s: ~meets("base", s) & ~meets("failed", s))
    df = df.withColumn(FOUND, apart)
    instance = lambda s, seed: F.struct(s["st"].alias("st"), s["en"].alias("en"), F.lower(s["v"]).alias("v"), F.lit(seed).alias("seed"), contexts(s["st"], s["en"]).alias("patterns"))
    instances = F.concat(F.transform("base", lambda s: instance(s, True)), F.transform(FOUND, lambda s: instance(s, False)))
    out = df.select(F.monotonically_increasing_id().alias("number"), "row", F.transform("base", lambda s: s.dropFields("v")).alias("base"), instances.alias("instances"))
    return materialise(out, "personal-data")


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and places: how often its one or two words stand in the texts, whatever is beside them.

    Words of no pattern go before any are counted, where the patterns are few enough for every task to have them; else all are counted.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORDS), F.lit(0))
    n = F.size("w")
    ones = F.transform("w", lambda a: F.xxhash64(a))
    twos = F.when(n > 1, F.zip_with(F.slice("w", F.lit(1), n - 1), F.slice("w", F.lit(2), n - 1), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<long>"))
    named = patterns.withColumn("gram", F.xxhash64(F.expr("substring(pattern, 2)")))
    grams = spread(docs).select(words.alias("w")).select(F.explode(F.concat(ones, twos)).alias("gram"))
    if patterns.count() <= MOST_SENT:
        grams = grams.join(F.broadcast(named.select("gram").distinct()), "gram", "left_semi")
    counts = grams.groupBy("gram").agg(F.count("*").alias("places"))
    return named.join(counts, "gram").select("pattern", "places")


def trusted_patterns(docs: DataFrame, found: DataFrame) -> DataFrame:
    """pattern and trust of the patterns that the graph ends up trusting."""
    each = found.select(F.explode("instances").alias("i")).select(F.col("i.v").alias("v"), F.col("i.seed").alias("seed"), F.explode("i.patterns").alias("pattern"))
    edges = materialise(each.groupBy("pattern", "v").agg(F.max("seed").alias("seed"), F.count("*").alias("k")), "edges")
    # a pattern with fewer different instances than it needs can never be trusted
    possible = materialise(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("k").alias("beside")).where(F.col("n") >= LEAST_SEEDS).select("pattern", "beside"), "patterns")
    places = occurrences(docs, possible.select("pattern"))
    negatives = materialise(possible.join(places, "pattern", "left").select("pattern", F.greatest(F.coalesce("places", F.lit(0)) - F.col("beside"), F.lit(0)).alias("negatives")), "negatives")
    edges = materialise(edges.join(negatives.select("pattern"), "pattern", "left_semi"), "edges")
    values = edges.groupBy("v").agg(F.max("seed").alias("sure"))
    promoted, count = materialise(values.where("sure").select("v"), "promoted"), -1
    while True:
        support = edges.join(promoted, "v", "left_semi").groupBy("pattern").agg(F.count("*").alias("n"), F.sum("k").alias("k")).where(F.col("n") >= LEAST_SEEDS)
        share = F.col("k") / (F.col("k") + F.col("negatives"))
        trust = materialise(support.join(negatives, "pattern").where(share >= LEAST_TRUST).select("pattern", (F.col("k") / (F.col("k") + F.col("negatives") + 1)).alias("trust")), "trust")
        doubt = edges.join(trust, "pattern").groupBy("v").agg(F.sum(F.log1p(-F.col("trust"))).alias("doubt"))
        more = doubt.where(1 - F.exp("doubt") >= LEAST_SURE).select("v")
        promoted = materialise(promoted.union(more).distinct(), "promoted")
        before, count = count, promoted.count()
        if count == before:
            return trust


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """row (the kept columns), base and spans: arrays of (st, rank, en, kind), in order."""
    found = extract(docs, *keep)
    each = found.select("number", F.explode("instances").alias("i")).where("not i.seed").select("number", "i.st", "i.en", F.explode("i.patterns").alias("pattern"))
    new = each.join(trusted_patterns(docs, found), "pattern").select("number", F.struct("st", F.lit(len(KINDS)).alias("rank"), "en", F.lit(FOUND).alias("kind")).alias("span"))
    added = new.groupBy("number").agg(F.collect_set("span").alias("added"))
    kind = dict(found.dtypes)["base"]
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(kind))))
    return found.join(added, "number", "left").select("row", "base", spans.alias("spans"))


def listed(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["st"].cast("string"), s["en"].cast("string"))))


def numbers() -> list[Column]:
    """The number of base spans of each kind."""
    return [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]


def count_base(docs: DataFrame) -> DataFrame:
    """doc_id and the number of base spans of each kind, from which no contexts are learnt."""
    return add_base(docs, "doc_id").select("row.doc_id", *numbers())


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest and all spans of each document."""
    return find(docs, "doc_id").select("row.doc_id", *numbers(), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, and n_chars, where there is one, counted anew.

    All other columns stay as they are, whatever their names.
    """
    df = find(docs, *docs.columns).select("row", "spans", F.coalesce("row.text", F.lit("")).alias("text"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def go_on(acc: Column, s: Column) -> Column:
        apart = s["st"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["st"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["en"]).alias("at"), F.when(apart, more).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("spans", begin, go_on, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    df = df.select("row", (F.size("spans") > 0).alias("changed"), F.when(F.size("spans") > 0, whole).otherwise(F.col("row.text")).alias("text"))
    columns = []
    for name in docs.columns:
        own = F.col("row")[name]
        if name == "n_chars":
            own = F.when(F.col("changed"), F.length("text").cast(docs.schema[name].dataType)).otherwise(own)
        columns.append((F.col("text") if name == "text" else own).alias(name))
    return df.select(*columns)
