import random

import pytest
from pyspark.sql import functions as F

from rankweave.operators import ranking, views

STATS = "name string, total long, wins long, kos long, losses long, draws long, nationality string, weightClass string, imageUrl string, birthDate string, qualityWins long, gender string"


def stats(spark, rows):
    full = [(n, w + l, w, k, l, 0, "Brazil", "Lightweight", img, birth, q, "male") for n, w, l, k, img, birth, q in rows]
    return ranking.with_scores(spark.createDataFrame(full, STATS), 2024)


def names(df):
    return [r["name"] for r in df.orderBy("rank").collect()]


def test_thresholds(spark):
    s = stats(spark, [("a", 9, 0, 0, "i", None, 1), ("b", 10, 0, 0, "i", None, 1), ("c", 10, 0, 0, "", None, 1), ("d", 0, 10, 0, None, None, 0), ("e", 384, 1, 0, "i", None, 1), ("f", 385, 1, 0, "i", None, 1)])
    assert names(ranking.board(s, "best")) == ["b"]
    assert names(ranking.board(s, "worst")) == ["d"]
    assert set(names(ranking.board(s, "thirdary"))) == {"a", "b", "e"}


def test_scores_and_age(spark):
    s = stats(spark, [("a", 12, 0, 1, "i", "1964", 1), ("b", 12, 1, 1, "i", "1963", 1), ("c", 12, 5, 1, "i", "", 1), ("d", 0, 0, 0, "i", "0", 0)])
    got = {r["name"]: r for r in s.collect()}
    assert [got[x]["thirdaryScore"] for x in "abc"] == [12.0, 12.0, 2.4]
    assert [got[x]["isSenior"] for x in "abcd"] == [False, True, False, False]


@pytest.mark.parametrize("seed", range(3))
def test_quota_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(f"n{i}", rng.randrange(6), rng.random() < 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, score int, senior boolean")
    for quota in (1, 7, 100):
        want, taken = [], 0
        for r in sorted(rows, key=lambda r: (-r[1], r[0])):
            want.append(r[0])
            taken += not r[2]
            if taken >= quota:
                break
        got = ranking.quota_walk(df, [-F.col("score"), F.col("name")], ~F.col("senior"), quota)
        assert sorted(r.name for r in got.collect()) == sorted(want)


def test_bottom_boards_append_seniors(spark):
    s = stats(spark, [(f"n{i}", 5, 1, i, "i", None, i + 1) for i in range(4)] + [("old", 5, 1, 0, "i", "1930", 9)])
    got = ranking.board(s, "secondaryWorst", quota=2).orderBy("rank").collect()
    assert [(r["name"], r["section"], r["rank"]) for r in got] == [("n0", 0, 1), ("n1", 0, 2), ("old", 1, 3)]


def test_global_rank_is_the_sorted_place(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(97)))
    got = ranking.global_rank(df.repartition(7), [F.col("v").desc(), F.col("id")]).collect()
    want = sorted(got, key=lambda r: (-r.v, r.id))
    assert [r.rank for r in want] == list(range(1, 1001))
    assert ranking.global_rank(df.limit(0), [F.col("id")]).count() == 0


def test_previous_ranks_and_change(spark):
    s = stats(spark, [("a", 12, 0, 0, "i", None, 1), ("b", 11, 0, 0, "i", None, 1), ("c", 10, 0, 0, "i", None, 1)])
    prev = spark.createDataFrame([("best", "x", 1, None), ("best", "b", 2, "i"), ("best", "a", 3, "i")], "board string, name string, rank long, imageUrl string")
    all_ = ranking.boards(s, prev)
    got = {r["name"]: (r["rank"], r["previousRank"]) for r in all_.where("board = 'best'").collect()}
    assert got == {"a": (1, 2), "b": (2, 1), "c": (3, None)}  # the entry without an image took no place
    shown = {r["name"]: r["rankChange"] for r in views.view(all_, "best").collect()}
    assert shown == {"a": 1, "b": -1, "c": 0}


def test_views(spark):
    s = stats(spark, [("Ann (martial artist)", 12, 0, 3, "i", None, 1), ("Bob", 11, 0, 9, "i", None, 1)])
    b = ranking.boards(s)
    assert names(views.view(b, "best", sort_by="kos")) == ["Bob", "Ann (martial artist)"]
    assert names(views.view(b, "best", search="AN")) == ["Ann (martial artist)"]
    assert views.view(b, "best", search="(").count() == 0
    assert views.view(b, "best", gender="female").count() == 0
    assert views.view(b, "nothing").count() == 0
