"""Personal data: base spans against the plain patterns, added spans on planted contexts."""

import random
import re
from hashlib import sha256

import pytest

from evidara.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    text, out = text or "", []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            n = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(n) <= 19 and luhn(n)) or kind == "phone" and not 10 <= len(n) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def check(df):
    got = pii.report(df).collect()
    want = {}
    for r in df.collect():
        spans = brute(r.text)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.setdefault(str(r.doc_id), []).append((*(sum(s[3] == k for s in spans) for k in PLAIN), sha256(listed.encode()).hexdigest()))
    have = {}
    for r in got:
        have.setdefault(str(r.doc_id), []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    return got


def test_base_spans(spark, odd_docs, no_docs):
    assert pii.report(no_docs).count() == 0
    check(odd_docs)
    r = random.Random(9)
    bits = ["a@b.c", "x.y@z", ".d", "@", "_", "1.2.3.4", ".", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "  ", "-", "+1 (234) 555-6789", "+", "0001.002.3.255", "é🙂", "9", "378282246310005", "word", "\n", "(", "5555555555554444", "x_y%z@q-1.w-2.v"]
    check(spark.createDataFrame([(i, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for i in range(1500)], "doc_id long, text string"))


def test_very_long_runs(spark):
    # the plain patterns are quadratic on these, so they bound the lengths here
    texts = ["1" * 6000, "1 " * 4000, "a" * 6000, "a@" + "b." * 6000 + "c", "1.1.1." * 2000, "+1" + " " * 6000, "a@b.c " * 2000]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    long = ["1" * 200_000, "a" * 200_000, "a@" + "b." * 100_000 + "c", "+1" + " " * 200_000]
    got = pii.report(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == [(0, 0, 0, 0, 0), (1, 0, 0, 0, 0), (2, 1, 0, 0, 0), (3, 0, 0, 0, 0)]


def test_what_a_base_rule_rejects_is_not_found_again(spark):
    rows = [(i, f"card no 411111111111111{'1' if i else '2'} x, member m{i}@x{i}.org and member 4111-1111-1111-1112") for i in range(8)]
    spans = [r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all("id:" not in s for s in spans)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Please mail member m{i}@x{i}.org today") for i in range(8)]
    rows += [(100, "we know that member AB-99887766 left"), (101, "the part AB-99887766 and the part 123456 too"), (102, "a part 12345678 alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert spans[100] == "id:20:31" and spans[102] == "" and spans[101] == ""
    assert spans[0] == "email:19:28"


def test_bootstrap_spreads(spark):
    # one seeded context with few seeds and many unseen identifiers, most of their characters letters
    rows = [(i, f"the member m{i}@x{i}.org came") for i in range(6)] + [(100 + i, f"our member kx_{'abcdefghijkl'[i]}user went") for i in range(12)]
    # a second context that only discovered identifiers lead to, and one that follows from it; then a context on the right
    rows += [(200 + i, f"a badge kx_{'abcdefghijkl'[i]}user lay") for i in range(12)] + [(300, "his badge zz-top9 fell")]
    rows += [(400 + i, f"seen {i} at r{i}@y{i}.org yesterday") for i in range(6)] + [(500, "called: qq.w7 yesterday")]
    # ordinary words take the place of identifiers here
    rows += [(600 + i, f"from n{i}@z{i}.org") for i in range(6)] + [(700 + i, "from here on") for i in range(6)] + [(800, "from some_where")]
    spans = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(spans[100 + i] == "id:11:19" for i in range(12))
    assert spans[200] == "id:8:16" and spans[300] == "id:10:17" and spans[500] == "id:8:13"
    assert spans[800] == ""


def test_redact(spark, no_docs, odd_docs):
    assert pii.redact(no_docs).columns == no_docs.columns and pii.redact(no_docs).count() == 0
    assert pii.redact(odd_docs).columns == odd_docs.columns
    df = spark.createDataFrame([(1, "é a@b.co, +1 (234) 555-6789!", "en", 29), (2, None, None, None), (3, "plain", "en", 5)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert got == {1: ("é [EMAIL], [PHONE]!", 19), 2: (None, None), 3: ("plain", 5)}
    names = spark.createDataFrame([(1, "to a@b.co", "x", 7, 8)], "doc_id long, text string, `a.b` string, _spans long, row long")
    assert pii.redact(names).columns == names.columns and pii.redact(names).first() == (1, "to [EMAIL]", "x", 7, 8)


def test_words_that_reach_beyond_the_context_are_no_patterns(spark):
    """A part of a word stands nowhere as a word, so nothing would speak against it."""
    long = "x" * 48
    rows = [(i, f"{long} user{i}@example.org and so on") for i in range(8)] + [(100 + i, f"{long} plain words here") for i in range(40)] + [(200, f"{long} ab12cd34 it is")]
    rows += [(300 + i, f"see more {'y' * 60}{i} user{i}@example.com") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got[200] == "" and got[300].startswith("email:")


def test_base_spans_are_counted_without_learning(spark, tmp_path, odd_docs, no_docs, monkeypatch):
    from evidara.llm import queries

    want = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.report(odd_docs).collect())
    monkeypatch.setattr(pii, "trusted_patterns", None)
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
    got = queries.QUERIES["corpus_base_spans"](spark, str(tmp_path / "odd"))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone"] and sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == want
    assert queries.QUERIES["corpus_base_spans"](spark, str(tmp_path / "none")).count() == 0


def test_only_words_of_patterns_are_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "One two one two THREE"), (1, None), (2, "two, one: two"), (3, "four")], "doc_id long, text string")
    # a word on either side is two patterns
    patterns = spark.createDataFrame([("<two",), (">two",), (">one two",), ("<absent",)], "pattern string")
    want = [("<two", 4), (">one two", 3), (">two", 4)]
    few = pii.occurrences(docs, patterns)
    assert sorted(map(tuple, few.collect())) == want
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
    monkeypatch.setattr(pii, "MOST_SENT", 3, raising=False)
    all_words = pii.occurrences(docs, patterns)
    assert "LeftSemi" not in all_words._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, all_words.collect())) == want
