import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rankweave import runs
from rankweave.sources import snapshots

TREE = {
    "Category:Male mixed martial artists by nationality": (["Category:Brazilian male mixed martial artists"], []),
    "Category:Female mixed martial artists by nationality": (["Category:Brazilian female mixed martial artists"], []),
    "Category:Mixed martial artists by nationality": (["Category:American mixed martial artists", "Category:Brazilian male mixed martial artists", "Category:Olympic mixed martial artists"], []),
    "Category:Brazilian male mixed martial artists": (["Category:Male champions"], ["Ann", "Bob", "Template:X"]),
    "Category:Male champions": ([], ["Cy (fighter)"]),
    "Category:Brazilian female mixed martial artists": ([], ["Ann"]),
    "Category:American mixed martial artists": (["Category:American mixed martial artists by state", "Category:Lists of American mixed martial artists"], ["Dan"]),
    "Category:American mixed martial artists by state": (["Category:Mixed martial artists from Ohio"], []),
    "Category:Mixed martial artists from Ohio": ([], ["Eve"]),
    "Category:Olympic mixed martial artists": ([], ["Out"]),
    "Category:Lists of American mixed martial artists": ([], ["Also out"]),
}
WON = {"Ann": (12, 0), "Bob": (15, 0), "Cy (fighter)": (9, 3), "Dan": (0, 11), "Eve": (0, 14)}
#: What the recorded world adds to each record, by run.
STATE = {"plus": 0, "news": []}


def page(title):
    w, l = WON[title]
    w += (STATE["plus"] if title == "Ann" else 0)
    return "{{Infobox martial artist\n| image = " + title[0] + ".jpg\n| birth_date = {{birth date|1990|1|2}}\n| mma_kowin = %d\n| mma_decloss = %d\n| nationality = [[Brazil]]\n}}" % (w, l)


def recorded(url, params):
    if params.get("list") == "categorymembers":
        subs, pages = TREE.get(params["cmtitle"], ([], []))
        return 200, json.dumps({"query": {"categorymembers": [{"title": x} for x in (pages if params["cmtype"] == "page" else subs)]}})
    if "titles" in params:
        return 200, json.dumps({"query": {"pages": {str(i): {"title": t, "revisions": [{"slots": {"main": {"*": page(t)}}}]} for i, t in enumerate(params["titles"].split("|"), 1) if t in WON}}})
    if params["q"] == "Cy":
        return 429, ""
    assert params["from"] == "2024-01-02"
    return 200, json.dumps({"articles": [
        {"title": f"{params['q']} fights", "url": f"u-{params['q']}", "source": {"name": None}, "publishedAt": "2024-01-20T00:00:00Z"},
        {"title": "ann again", "url": "u-2", "source": {"name": "s"}, "publishedAt": "2024-01-30T00:00:00Z"},
        {"title": "nobody", "url": "u-3", "source": {"name": "s"}, "publishedAt": "2024-01-30T00:00:00Z"},
    ]})


OPTIONS = {"transport": "tests.test_runs:recorded", "retries": "0", "gap": "0"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two ranking runs; in the second Ann has passed Bob. The recorded world is changed through a file, since readers run elsewhere."""
    root = str(tmp_path_factory.mktemp("runs") / "boards")
    first = runs.rankings_run(spark, root, "2024-01-31", dt.datetime(2024, 1, 31), OPTIONS).collect()
    faster = {**OPTIONS, "transport": "tests.test_runs:later"}
    runs.rankings_run(spark, root, "2024-02-01", dt.datetime(2024, 2, 1), faster)
    return root, first


def later(url, params):
    STATE["plus"] = 10
    try:
        return recorded(url, params)
    finally:
        STATE["plus"] = 0


def test_rankings(spark, stored):
    root, first = stored
    said = {(r.what, r.place): (r.name, r.n) for r in first}
    assert said["requested", 0][1] == 5 and said["read", 0][1] == 5 and said["best", 1][0] == "Bob" and said["best", 0][1] == 2
    best = snapshots.load_board(spark, root, "best").collect()
    assert [(r.name, r.gender, r.previousRank, r.rank) for r in best] == [("Ann", "female", 2, 1), ("Bob", "male", 1, 2)]
    assert best[0].wikipediaUrl.endswith("/Ann") and best[0].secondaryScore is None and best[0].isSenior is None and best[0].nationality == "Brazil"
    worst = snapshots.load_board(spark, root, "worst").collect()
    assert [(r.name, r.gender, r.previousRank) for r in worst] == [("Eve", "male", 1), ("Dan", "male", 2)]
    third = snapshots.load_board(spark, root, "thirdary").collect()
    assert [r.name for r in third] == ["Ann", "Bob", "Cy (fighter)"] and third[0].isSenior is False and third[0].previousRank is None
    assert snapshots.read_boards(spark, root, back=1).where("board = 'best' and rank = 1").first()["name"] == "Bob"


def test_nothing_discovered_writes_nothing(spark, tmp_path):
    assert runs.rankings_run(spark, str(tmp_path / "b"), "1", dt.datetime(2024, 1, 1), OPTIONS, roots=("a", "b", "c")) is None
    assert snapshots.runs(spark, str(tmp_path / "b")) == []


def test_news(spark, stored, tmp_path):
    root, news_root, sent = stored[0], str(tmp_path / "news"), []
    with_key = {**OPTIONS, "apikey": "k"}
    at = dt.datetime(2024, 2, 1)
    assert runs.news_run(spark, root, news_root, "0", at, OPTIONS) and snapshots.read_news(spark, news_root).count() == 0  # no key: an empty run
    assert runs.news_run(spark, root, news_root, "1", at, with_key, send=lambda d: sent.extend(r.line for r in d.collect()))
    got = {(r.boxerName, r.url, r.source) for r in snapshots.read_news(spark, news_root).collect()}
    assert got == {("Ann", "u-Ann", "News"), ("Bob", "u-Bob", "News"), ("Ann", "u-2", "s")}
    assert len(sent) == 3 and "- ann again [s, 2024-01-30] u-2" in sent
    sent.clear()
    assert runs.news_run(spark, root, news_root, "2", at, with_key, send=lambda d: sent.extend(r.line for r in d.collect()))
    assert sent == [] and snapshots.read_news(spark, news_root).count() == 3
    later_on = dt.datetime(2024, 2, 1)
    assert runs.cutoff(later_on) == "2024-01-02T00:00:00.000Z"


def test_a_refused_search_stops_the_rest(spark):
    from rankweave.sources import api

    names = spark.createDataFrame([("Ann",), ("Cy",), ("Zed",), (None,)], "name string")
    got = {r.fighter: r.error for r in api.fetch(names, "name", "articles", {**OPTIONS, "from": "2024-01-02"}, 1).collect()}
    assert got == {"Ann": None, "Cy": "status 429", "Zed": "not tried after status 429"}


def test_pace(monkeypatch):
    from rankweave.sources import api

    slept = []
    monkeypatch.setattr(api.time, "sleep", slept.append)
    client = api._Client({**OPTIONS, "gap": "1.1"})
    for _ in range(3):
        client.json("u", {"titles": "Ann"})
    assert slept == [1.1, 1.1]
    assert len(api._Members({"values": json.dumps(list("abcdefghijk"))}).partitions()) <= 5


def test_large_boards_are_files_not_one_document(spark, tmp_path):
    rows = spark.range(50).select(F.lit("best").alias("board"), F.col("id").cast("string").alias("name"), (F.col("id") + 1).alias("rank"), F.lit(0).alias("section"))
    snapshots.write_boards(rows, str(tmp_path / "b"), "1", rows_per_file=10)
    assert [r["rank"] for r in snapshots.load_board(spark, str(tmp_path / "b"), "best").collect()] == list(range(1, 51))
    with pytest.raises(ValueError):
        snapshots.rankings_document(rows, "now", max_rows=10)
