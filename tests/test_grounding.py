"""Numbers, rates, metrics and folds on sentences with known answers."""

import pytest
from pyspark.sql import functions as F

from evidara.functions import grounding as G
from evidara.operators import chunking, rules


def only(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Revenue was $75. 2 billion, up 12.5% and (3,450) in 2024.", [(75.2e9, "amount", "usd"), (12.5, "percent", None), (-3450, "amount", None)]),
        ("[Evidence 15] page 12 and 25 bps", [(25, "basis_points", None)]),
        ("April 26, 2026 had 5 items; US$ 7", [(7, "amount", "usd")]),
        ("3.5亿美元 and 20万", [(3.5e8, "amount", "usd"), (2e5, "amount", None)]),
        ("5 Boys 12x Form 10-Q | 16", []),
        (None, []),
    ],
)
def test_numbers(spark, text, want):
    got = only(spark, G.numbers("t"), t=text)
    assert [(float(n.value), n.kind, n.currency) for n in got] == want


def test_growth_rates_and_dispositions(spark):
    rates = lambda t: [(r.basis, r.rate) for r in only(spark, G.growth_rates("t"), t=t)]
    assert rates("sales fell 12.5% year over year, up 3% sequentially") == [("yoy", -12.5), ("qoq", 3.0)]
    assert rates("up 3% by 2 percentage points yoy") == []
    disposed = lambda line, e: only(spark, G.disposition(F.col("l"), G.numbers("e")), l=line, e=e)
    assert disposed("up 20% to 120 million", "120 million against 100 million") == "DERIVABLE"
    assert disposed("121 million, up 20%", "120 million against 100 million") == "UNSUPPORTED"
    assert disposed("120.0 million", "120.04 million") == "SUPPORTED"
    assert disposed("fine", "1 million") == "NON_NUMERIC"


def blocks(*texts):
    return [(t, "text") if isinstance(t, str) else t for t in texts]


def plain_chunks(items, size, overlap):
    """Blocks packed one by one, as lists."""
    length = lambda bs: sum(len(t) for t, _ in bs) + 2 * (len(bs) - 1) if bs else 0
    out, now = [], []
    for b in items:
        border = any({k, b[1]} == {"table", "unverified_table"} for _, k in now)
        if now and (border or length([*now, b]) > size):
            out.append(now)
            carried, n = [], 0
            for x in reversed(now) if overlap and not border else []:
                if carried and n + len(x[0]) > overlap:
                    break
                carried.insert(0, x)
                n += len(x[0])
                if n >= overlap:
                    break
            while carried and length([*carried, b]) > size:
                carried.pop(0)
            now = carried
        now = [*now, b]
    return out + ([now] if now else [])


@pytest.mark.parametrize("overlap", [0, 8, 15])
def test_chunk_groups(spark, overlap):
    cases = [blocks("a" * 9, "b" * 9, "c" * 5, "d" * 20, "e"), blocks(), blocks("x" * 3, ("t" * 4, "table"), ("u" * 4, "unverified_table"), "y", ("t", "table")), blocks(*("w" * n for n in range(1, 12)))]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, b array<struct<text:string,kind:string>>")
    got = {r.i: [[(b.text, b.kind) for b in g] for g in r.g] for r in df.select("i", chunking.chunk_groups(F.col("b"), 25, overlap).alias("g")).collect()}
    assert got == {i: plain_chunks(c, 25, overlap) for i, c in enumerate(cases)}
    with pytest.raises(ValueError):
        chunking.chunk_groups(F.col("b"), 5, 5)


def test_sentence_pieces(spark):
    pieces = lambda t, n, o=0: only(spark, chunking.sentence_pieces(F.col("t"), n, o), t=t)
    assert pieces("One two. Three four! Five?", 18) == ["One two.", "Three four! Five?"]
    assert pieces("One two. Three four! Five?", 19, 4) == ["One two.", "two. Three four!", "our! Five?"]
    assert pieces("short", 10) == ["short"] and "".join(pieces("x" * 25, 10)) == "x" * 25


def test_union_area(spark):
    df = spark.createDataFrame([([(0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0), (5.0, 5.0, 5.0, 9.0)],), ([],)], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert [r.a for r in df.select(rules.union_area(F.col("b")).alias("a")).collect()] == [7.0, 0.0]
