"""The suffix tree against a plain one that keeps every count in dictionaries."""

import random
import zlib
from collections import Counter, defaultdict
from math import log, log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidara.llm import suffix_tree as st


LEAST_CONTEXT, LEAST_ENTRY = 32, 4
UNPATCHED = st.thresholds


@pytest.fixture(autouse=True)
def small_counts(monkeypatch):
    """Thresholds that a small corpus reaches; they are used on the driver alone."""
    monkeypatch.setattr(st, "thresholds", lambda total: (LEAST_CONTEXT, LEAST_ENTRY))


def split(text):
    words, now = [], b""
    for b in (text or "").encode() + b" ":
        if b in b" \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = b""
        else:
            now += bytes([b + 32 if 65 <= b <= 90 else b])
    return [*words, b""]


class Plain:
    """Counts of all grams, tested contexts with their suffixes, and distributions that back off one word at a time."""

    def __init__(self, texts):
        self.n = Counter()
        for w in map(split, texts):
            for i in range(len(w)):
                for d in range(1, st.DEPTH + 2):
                    if i + d <= len(w):
                        self.n[tuple(w[i : i + d])] += 1
        self.total = sum(v for k, v in self.n.items() if len(k) == 1)
        self.distinct = sum(len(k) == 1 for k in self.n)
        self.after = defaultdict(list)
        for k, v in self.n.items():
            if len(k) > 1 and v >= LEAST_ENTRY and self.n[k[:-1]] >= LEAST_CONTEXT:
                self.after[k[:-1]].append(k[-1])
        self.kept = set()
        for ctx, words in self.after.items():
            if self.diverges(ctx, words):
                self.kept |= {ctx[i:] for i in range(len(ctx))}

    def root(self, word):
        return (self.n[(word,)] + 1) / (self.total + self.distinct + 1)

    def diverges(self, ctx, words):
        p = [(self.n[(*ctx, w)] - st.DISCOUNT) / self.n[ctx] for w in words]
        q = [self.n[(*ctx[1:], w)] / self.n[ctx[1:]] if len(ctx) > 1 else self.root(w) for w in words]
        rest, rest_q = max(1 - sum(p), 1e-12), max(1 - sum(q), 1e-12)
        return self.n[ctx] * (sum(a * log(a / b) for a, b in zip(p, q)) + rest * log(rest / rest_q)) >= st.LEAST_GAIN

    def chance(self, ctx, word):
        while ctx and ctx not in self.kept:
            ctx = ctx[1:]
        if not ctx:
            return self.root(word)
        if word in self.after[ctx]:
            return (self.n[(*ctx, word)] - st.DISCOUNT) / self.n[ctx]
        spent = sum((self.n[(*ctx, w)] - st.DISCOUNT) / self.n[ctx] for w in self.after[ctx])
        by_suffix = sum(self.chance(ctx[1:], w) for w in self.after[ctx])
        return max(1 - spent, 1e-12) / max(1 - by_suffix, 1e-12) * self.chance(ctx[1:], word)

    def score(self, text):
        w = split(text)
        return sum(log10(self.chance(tuple(w[max(0, i - st.DEPTH) : i]), w[i])) for i in range(len(w)))


def corpus(n=300, seed=3):
    """Two languages that do not mix, so a word foretells the next, and runs whose next word needs two before it."""
    r = random.Random(seed)
    tongues = [["la", "de", "que"] + [f"a{i}x" for i in range(20)], ["the", "of", "and"] + [f"b{i}y" for i in range(20)]]
    rows = []
    for i in range(n):
        if i % 3:
            rows.append((i, " ".join(r.choice(r.choice(tongues)[: r.choice([3, 23])]) for _ in range(r.randint(0, 60)))))
        else:
            w = [0, r.randrange(5)]
            while len(w) < 40:
                w.append((w[-1] + w[-2] * 3 + r.choice([0, 0, 0, 1])) % 5)
            rows.append((i, " ".join(f"W{x}" for x in w)))
    return rows


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("top", [(1e-6, 4e-6), (0.03, 0.01), (2.0, 2.0)])
def test_scores_are_those_of_a_plain_tree(spark, odd_docs, monkeypatch, top):
    monkeypatch.setattr(st, "TOP_WORD", top[0])
    monkeypatch.setattr(st, "TOP_GRAM", top[1])
    rows = corpus() + [(1000 + (r.doc_id or 0), r.text) for r in odd_docs.distinct().collect() if r.doc_id is not None] + [(None, "la de")]
    plain = Plain([t for d, t in rows if not held(d)])
    assert {len(c) for c in plain.kept} >= {1, 2}
    got = st.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by_id = {str(d): t for d, t in rows}
    for r in got:
        w = split(by_id[str(r.doc_id)])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(plain.n[(x,)] > 0 for x in w), plain.total)
        assert r.base_score == pytest.approx(sum(log10(plain.root(x)) for x in w), rel=1e-9)
        assert r.score == pytest.approx(plain.score(by_id[str(r.doc_id)]), rel=1e-9)
    fair = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in fair) > 0.9 * sum(r.base_score for r in fair)


def test_plain_distributions_sum_to_one():
    plain = Plain([t for _, t in corpus()])
    words = [k[0] for k in plain.n if len(k) == 1]
    unknown = 1 - sum(map(plain.root, words))
    for ctx in list(plain.kept)[:40]:
        rest = plain.chance(ctx, b"never met") / plain.root(b"never met") * unknown
        assert sum(plain.chance(ctx, w) for w in words) + rest == pytest.approx(1, abs=1e-9), ctx


def test_more_text_gives_a_larger_tree(spark):
    sizes = []
    for n in (60, 240):
        docs = spark.createDataFrame(corpus(n, 5), "doc_id long, text string")
        sizes.append(st.grow(docs, st.word_counts(docs)).values.count())
    assert sizes[1] > 2 * sizes[0] > 0


def test_thresholds_leave_room_to_grow():
    now, then = UNPATCHED(10**6), UNPATCHED(10**10)
    # a corpus of 10,000 times the tokens may hold 100 times the contexts and entries
    assert [b / a for a, b in zip(now, then)] == [pytest.approx(100)] * 2


def test_empty_and_repeated(spark, odd_docs, no_docs):
    assert st.score(no_docs).count() == 0
    assert st.score(odd_docs).count() == odd_docs.count()


def test_names_are_those_that_spark_gives(spark):
    x = np.random.default_rng(2).integers(-(2**63), 2**63, (2, 500))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in x.T], "a long, b long").select(F.xxhash64("a", "b").alias("h"))
    assert [r.h for r in df.collect()] == st.named(x[0].view(np.uint64), x[1].view(np.uint64)).view(np.int64).tolist()


def test_a_map_forgets_nothing(spark):
    x = np.random.default_rng(4).integers(-(2**63), 2**63, 3000)
    m = st.BitMap.of(spark.createDataFrame([(int(a),) for a in x], "name long"), st.BITS)
    assert m.may_hold(x.view(np.uint64)).all()
    other = np.random.default_rng(5).integers(-(2**63), 2**63, 100_000)
    assert m.may_hold(other.view(np.uint64)).mean() < 0.001


def test_tokens_and_grams():
    texts = ["A b\ta", "", " x ", "é\x85É Z", "\n"]
    h, begins = st.tokens(pa.array([t.encode() for t in texts], pa.binary()))
    words = [split(t) for t in texts]
    assert np.diff(begins).tolist() == [len(w) for w in words]
    assert h.tolist() == [st.xxh3_64_intdigest(x) for w in words for x in w]
    flat = [(i, x) for i, w in enumerate(words) for x in w]
    for n, (place, ctx, suf, name) in enumerate(st.grams(h, begins, 3), 2):
        want = [p for p in range(len(flat)) if p >= n - 1 and len({flat[q][0] for q in range(p - n + 1, p + 1)}) == 1]
        assert place.tolist() == want
        assert (name == st.named(ctx, suf)).all()
