"""Fingerprints against a plain reading of their definition."""

import random
from hashlib import sha256

import numpy as np
import pytest

from evidara.llm import fingerprints as fp


def edited_pairs(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        yield doc_id, text, text[: len(text) - half] + following[:half], following


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for doc_id, text, edited, following in edited_pairs(rows):
        a, b, c = fp.sketch(text), fp.sketch(edited), fp.sketch(following)
        want.append((str(doc_id), len(text), sha256(edited.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), b.astype(">u4").tobytes().hex(), fp.likeness(a, b), fp.likeness(a, c)))
    assert sorted((str(r[0]), *r[1:]) for r in fp.fingerprint(df).collect()) == sorted(want)


def test_every_row(spark, odd_docs, no_docs, monkeypatch):
    assert fp.fingerprint(no_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(spark, rows)
    monkeypatch.setattr(fp, "RUN_CHARS", 300)
    check(spark, rows)
    r = random.Random(2)
    check(spark, [(i * 7 % 1000, "".join(r.choice("abcé 🙂") for _ in range(r.randint(0, 80)))) for i in range(300)])


def test_ids_of_any_type_and_large_groups_of_one_id(spark, monkeypatch):
    """The ranges give what one sort gives, where ids are text and where most rows share an id or have none."""
    monkeypatch.setattr(fp, "RUN_CHARS", 400)
    r = random.Random(6)
    some = lambda: "".join(r.choice("abcé 🙂") for _ in range(r.randint(0, 80)))
    for ids in ([f"d{i:03}é"[: r.randint(2, 5)] for i in range(200)], [r.choice([None, "a", "a", "b"]) for _ in range(200)]):
        rows = list({(i, some()) for i in ids})
        order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]), reverse=True)
        df = spark.createDataFrame(rows, "doc_id string, text string").withColumnRenamed("doc_id", "doc_id")
        want = sorted((str(a[0]), a[1], order[(i + 1) % len(order)][1]) for i, a in enumerate(order))
        assert sorted((str(x.doc_id), x.text, x.next) for x in fp.with_next(df).collect()) == want


def test_anchors_are_closed_syncmers():
    r = random.Random(3)
    text = "".join(r.choice("abcdefg ") for _ in range(400))
    inner = fp.window_hash(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), fp.S)
    want = []
    for i in range(len(text) - fp.K + 1):
        w = inner[i : i + fp.K - fp.S + 1].tolist()
        if min(w) in (w[0], w[-1]):
            want.append(i)
    h, at = fp.anchors(text)
    assert at.tolist() == want
    # context-free: the same passage elsewhere has the same anchors
    h2, at2 = fp.anchors("zzzz" + text)
    assert [(x, y) for x, y in zip(h2.tolist(), (at2 - 4).tolist()) if y >= 0] == list(zip(h.tolist(), at.tolist()))
    assert max(np.diff(at)) <= fp.K - fp.S + 1


def test_likeness():
    r = random.Random(4)
    a, b = ("".join(r.choice("abcdefghij ") for _ in range(3000)) for _ in range(2))
    assert fp.likeness(fp.sketch(a), fp.sketch(a)) == 1
    assert fp.likeness(fp.sketch(a), fp.sketch(a[:1500] + b[:1500])) == pytest.approx(1 / 3, abs=0.15)
    assert fp.likeness(fp.sketch(a), fp.sketch(b)) < 0.05


def test_positions(odd_docs, no_docs):
    assert fp.positions(no_docs).count() == 0
    assert fp.positions(odd_docs).count() == sum(len(fp.anchors(r.text or "")[0]) for r in odd_docs.collect())
