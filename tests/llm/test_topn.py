import random

import pytest

from rankweave.llm.topn import top_n


def brute(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r[:2], []).append(r)
    low = lambda v: (v is not None, v if v is not None else 0)
    out = []
    for g in by.values():
        out += sorted(g, key=lambda r: (low(r[2]), (r[3] is not None, -(r[3] or 0)), (r[4] is not None, -(r[4] or 0))), reverse=True)[:n]
    return out


@pytest.mark.parametrize("n, midpoints, hot, wide", [(3, 63, 10**6, False), (5, 1, 50, False), (1, 3, 20, True)])
def test_against_sort(spark, n, midpoints, hot, wide):
    rng = random.Random(n)
    scale = 2**53 if wide else 1
    rows = []
    for i in range(900):
        g = rng.choice(["hot", "hot", None, "", f"g{rng.randrange(40)}"])
        rows.append((g, rng.choice(["m", None]) if g != "hot" else "m", rng.choice([None, 5, 5, rng.randrange(-9, 9)]), rng.choice([None, 1, 2]), i * scale - 7))
    df = spark.createDataFrame(rows, "g string, h string, a long, b long, id long")
    got = [tuple(r) for r in top_n(df, ["g", "h"], [("a", True), ("b", False), ("id", False)], n, midpoints, hot).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, n), key=str)


def test_edges(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 0, 2)], "g string, s long, id long")
    order = [("s", True), ("id", False)]
    assert top_n(df, ["g"], order, 1).count() == 2  # rows that can't be told apart stay together
    assert top_n(df, ["g"], order, 0).count() == 0
    assert top_n(df.limit(0), ["g"], order, 3).count() == 0
    assert top_n(df.selectExpr("g", "cast(null as long) s", "cast(null as long) id"), ["g"], order, 3).count() == 3


def test_more_bits_than_a_code_holds(spark):
    rng = random.Random(11)
    big = 2**62
    rows = [(rng.choice(["hot", "hot", None, f"g{rng.randrange(20)}"]), "m", rng.choice([None, big, -big, 7]), rng.choice([None, big, -big, 1]), i * 2**52 - 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, h string, a long, b long, id long")
    for n, hot in ((3, 10**6), (40, 50)):
        got = [tuple(r) for r in top_n(df, ["g", "h"], [("a", True), ("b", False), ("id", False)], n, 63, hot).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, n), key=str)
