"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
HAN = r"\p{IsHan}+"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Letter and digit runs in lower case."""
    return F.regexp_extract_all(F.lower(column(text)), F.lit(WORD), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Words, and after each the adjacent pairs of its Han runs (a run of two only where it isn't the whole word)."""

    def with_pairs(w: Column) -> Column:
        runs = F.filter(F.regexp_extract_all(w, F.lit(HAN), F.lit(0)), lambda r: (F.length(r) > 2) | (F.length(r) == 2) & (r != w))
        pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
        return F.concat(F.array(w), pairs)

    # the pairs are looked for only in texts that hold Han at all
    return F.when(column(text).rlike(HAN), F.flatten(F.transform(words(text), with_pairs))).otherwise(words(text))


def clean(text: Column | str) -> Column:
    """Words cut by a line end are joined, white space becomes one space."""
    joined = F.regexp_replace(column(text), r"(\w)-\s*\n\s*(\w)", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"[^\S\n]+", " "), r"\s*\n\s*", " "))


def normal(text: Column | str) -> Column:
    """White space to one space, trimmed, in lower case: the key of equal content."""
    return F.lower(F.trim(F.regexp_replace(column(text), r"\s+", " ")))


def content_hash(text: Column | str) -> Column:
    return F.sha2(normal(text), 256)


def windows(text: Column | str, size: int, overlap: int) -> Column:
    """Fixed windows of size code points; each starts size - overlap after the one before, the last ends the text."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to under size")
    t, step = column(text), size - overlap
    last = F.greatest(F.ceil((F.length(t) - overlap) / step).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.substring(t, i * step + 1, F.lit(size)))


def cell(text: Column | str, most: int = 4000) -> Column:
    """A table cell: clean, and cut at so many characters with a mark."""
    t = clean(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def row_text(headers: Column, values: Column) -> Column:
    """A table row as 'header: value | ...'; blank values are left out, a blank header is numbered."""
    pairs = F.transform(F.arrays_zip(headers.alias("h"), values.alias("v")), lambda p, i: F.when(F.trim(F.coalesce(p["v"], F.lit(""))) != "", F.concat(F.when(F.trim(F.coalesce(p["h"], F.lit(""))) != "", F.trim(p["h"])).otherwise(F.concat(F.lit("column "), (i + 1).cast("string"))), F.lit(": "), F.trim(p["v"]))))
    return F.concat_ws(" | ", F.array_compact(pairs))


def keyword(question: Column | str) -> Column:
    """The longest word of more than 3 letters; of equals the first; else null."""
    found = F.filter(words(question), lambda w: F.length(w) > 3)
    ranked = F.transform(found, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"), w.alias("w")))
    return F.array_max(ranked)["w"]


def luhn_valid(text: Column | str) -> Column:
    """13 to 19 digits that pass the mod-10 check."""
    digits = F.regexp_replace(column(text), "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


#: Names and formats of secrets, which must be as they are for equal reports.
SECRETS = {
    "private key": r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----",
    "cloud access key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "GitHub token": r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b",
    "OpenAI-style API key": r"\bsk-[A-Za-z0-9_-]{16,}\b",
    "credential assignment": r"(?i)\b(?:api[_-]?key|secret|password|access[_-]?token|auth[_-]?token)\b\s*[:=]\s*[^\s<][^\s]{5,}",
    "authorization header": r"(?i)\bBearer\s+[A-Za-z0-9._~-]{12,}\b",
}


#: Formats of personal data, which must be as they are for equal reports.
PERSONAL = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "us ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "cn id": r"(?<![0-9A-Za-z])[1-9]\d{16}[\dXx](?![0-9A-Za-z])",
    "cn phone": r"(?<!\d)1[3-9]\d{9}(?!\d)",
    "international phone": r"(?<!\w)\+\d{1,3}[ .-]?\d{3,4}[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)",
}
#: Fixed value: what may be a payment card, from each group of digits on, as a number before it (126 4880...) must not hide it; the check digit decides.
CARD = r"(?<!\d)(?=((?:\d[ -]?){12,18}\d(?!\d)))"
SENSITIVE = {**SECRETS, **PERSONAL}
#: What a text must hold for a class to be looked for at all: plain searches, far cheaper than the patterns.
HINTS = {"private key": "PRIVATE KEY-----", "OpenAI-style API key": "sk-", "email": "@", "international phone": "+"}
#: Digits in a row, blanks and hyphens between, that the classes of numbers need at least.
DIGITS = {"us ssn": r"\d-\d\d-\d", "cn id": r"\d{16}", "cn phone": r"\d{11}", "card": r"\d(?:[ -]?\d){12}"}


def sensitive_classes(text: Column | str) -> Column:
    """Names of the classes found in a text."""
    t = column(text)

    def found(name: str, test: Column) -> Column:
        if name in HINTS:
            test = F.contains(t, F.lit(HINTS[name])) & test
        if name in DIGITS:
            test = t.rlike(DIGITS[name]) & test
        return F.when(test, F.lit(name))

    cards = F.exists(F.regexp_extract_all(t, F.lit(CARD), F.lit(1)), luhn_valid)
    return F.array_compact(F.array(*(found(k, t.rlike(p)) for k, p in SENSITIVE.items()), found("card", cards)))


def alphanumeric_share(text: Column | str) -> Column:
    """Letters and digits among the characters that are not white space."""
    shown = F.length(F.regexp_replace(column(text), r"\s+", ""))
    return F.try_divide(F.length(F.regexp_replace(column(text), r"[^\p{L}\p{N}]+", "")).cast("double"), shown.cast("double"))


def listed(text: Column | str) -> Column:
    """Values parted by pipes or commas, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(F.replace(column(text), F.lit(","), F.lit("|")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def authority(named: Column, tenant: Column) -> Column:
    """The stated authority of a source in lower case, else public for tenant 0 and private for the others."""
    return F.coalesce(F.nullif(F.lower(F.trim(named)), F.lit("")), F.when(tenant == 0, "public").otherwise("private"))
