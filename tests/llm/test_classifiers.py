"""Toxicity and quality: base counts by brute force, learnt parts on rows held out."""

import random
import zlib
from collections import Counter

import pytest

from evidara.llm import linear, quality, toxicity
from evidara.llm.common import SPACE


@pytest.fixture(scope="module")
def marked(spark):
    """Texts of which some have rude words, some are torn by symbols."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = [r.choice(words) for _ in range(r.randint(25, 80))]
        toxic, bad = r.random() < 0.25, r.random() < 0.25
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["rude", "vile", "nasty"]))
        docs.append((i, "### ".join(text) if bad else " ".join(text)))
        if i % 3:
            labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    docs.append((9999, None))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out(marked):
    docs, labels = marked
    rows = toxicity.detect(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    rude = {d.doc_id: any(w in (d.text or "") for w in ("rude", "vile", "nasty")) for d in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == rude[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {r.doc_id for r in rows if r.predicted == 0 and not rude[r.doc_id]} - set(range(600)) | {9999}


def test_toxicity_weights_are_sparse(marked):
    docs, labels = marked
    weights = toxicity.fit(docs, labels)
    assert 0 < (weights != 0).sum() < 5000


def test_no_labels(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.detect(odd_docs, none).collect()} == {0.5}
    assert toxicity.detect(no_docs, none).count() == 0 and quality.rate(no_docs, none).count() == 0
    assert toxicity.keep_clean(no_docs, none).columns == no_docs.columns
    assert quality.rate(odd_docs, none).count() == odd_docs.count()
    kept = quality.keep_good(odd_docs, none)
    assert kept.columns == odd_docs.columns


def test_learning_is_plain_ftrl():
    """The learner's weights are those of the published update, one coordinate at a time."""
    import numpy as np

    r = np.random.default_rng(4)
    model = linear.Ftrl(bits=6, alpha=0.5, beta=1.0, l1=0.3, l2=0.1, epochs=3)
    examples = [(float(r.random() < 0.4), np.unique(r.integers(0, 64, 6)).astype(np.int32), np.zeros(0, np.float32)) for _ in range(60)]
    examples += [(1.0, np.array([3, 9], np.int32), np.array([0.5, -2.0], np.float32))]
    z, n, w = [0.0] * 64, [0.0] * 64, [0.0] * 64
    order = np.random.default_rng(len(examples))
    for _ in range(model.epochs):
        for i in order.permutation(len(examples)):
            y, idx, x = examples[i]
            x = x if len(x) else np.ones(len(idx))
            for j in idx:
                w[j] = 0.0 if abs(z[j]) <= model.l1 else -(z[j] - np.sign(z[j]) * model.l1) / ((model.beta + n[j] ** 0.5) / model.alpha + model.l2)
            p = 1 / (1 + np.exp(-sum(w[j] * v for j, v in zip(idx, x))))
            for j, v in zip(idx, x):
                g = (p - y) * v
                z[j] += g - ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / model.alpha * w[j]
                n[j] += g * g
    want = [0.0 if abs(a) <= model.l1 else -(a - np.sign(a) * model.l1) / ((model.beta + b**0.5) / model.alpha + model.l2) for a, b in zip(z, n)]
    assert linear.learn(examples, model) == pytest.approx(np.array(want), abs=1e-9)


def test_names_of_other_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "x", 2.0)], "doc_id long, text string, `a.b` string, toxicity_score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(docs, none.unionByName(spark.createDataFrame([(1, 1, 0)], none.schema)))
    assert kept.columns == docs.columns
    assert quality.keep_good(docs, none).columns == docs.columns


def brute_base(text):
    text = text or ""
    words, now = [], ""
    for c in text + " ":
        if c in SPACE:
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    lines = [x for x in text.split("\n") if any(c not in SPACE for c in x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_base_counts(spark, odd_docs):
    r = random.Random(6)
    rows = [(i, "".join(r.choice(["a ", "b ", "c\n", "a b c\n", " \n", "# ", "é|\x85 ", "\x1f"]) for _ in range(r.randint(0, 120)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.rate(docs, none).collect()
    want = sorted((str(d.doc_id), *brute_base(d.text)) for d in docs.collect())
    assert sorted((str(x.doc_id), x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in got) == want
    for x in got:
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)
        assert x.kept == (not x.base_failed)


def test_quality_verdict(marked):
    docs, labels = marked
    torn = {d.doc_id: "###" in (d.text or "") for d in docs.collect()}
    rows = [r for r in quality.rate(docs, labels).collect() if not r.base_failed]
    assert sum(r.kept != torn[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {r.doc_id for r in rows if r.kept}


def test_margin_is_the_features_sum():
    import numpy as np

    w = np.random.default_rng(0).normal(size=1 << quality.MODEL.bits).astype(np.float32)
    for text in (b"", b"a", "one two é two one".encode() * 9):
        idx, x = quality.featurise(text)
        assert quality.margin(text, w) == pytest.approx(float(w[idx] @ x), abs=1e-3)


def test_platt():
    import numpy as np

    r = np.random.default_rng(1)
    m = r.normal(size=4000)
    y = (r.random(4000) < linear.sigmoid(2.5 * m - 1)).astype(float)
    slope, shift = quality.platt(m, y)
    assert slope == pytest.approx(2.5, abs=0.25) and shift == pytest.approx(-1, abs=0.2)
    assert quality.platt(m[:5], y[:5]) == (1.0, 0.0)
