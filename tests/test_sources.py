import json

import pytest
from pyspark.sql import functions as F

from rankweave.operators import ranking
from rankweave.sources import api, snapshots
from tests.test_ranking import stats


def recorded(url, params):
    """Answers as a web interface would give them; one category is busy for ever."""
    if params.get("list") == "categorymembers":
        if params["cmtitle"] == "busy":
            return 429, ""
        if params["cmtype"] == "subcat":
            return 200, json.dumps({"query": {"categorymembers": []}})
        if "cmcontinue" in params:
            return 200, json.dumps({"query": {"categorymembers": [{"title": "P2", "ns": 0}]}})
        return 200, json.dumps({"query": {"categorymembers": [{"title": "P1", "ns": 0}]}, "continue": {"cmcontinue": "x"}})
    if "titles" in params:
        return 200, json.dumps({"query": {"pages": {"7": {"title": "P1", "revisions": [{"slots": {"main": {"*": "text"}}}]}, "-1": {"title": "gone"}}}})
    return (200, json.dumps({"articles": [{"title": "t", "url": "u", "source": {"name": "s"}, "publishedAt": "d"}]})) if params["q"] == "ok" else (500, "")


def load(spark, name, values):
    api.register(spark)
    return spark.read.format(name).option("transport", "tests.test_sources:recorded").option("retries", "1").option("pause", "0").option("values", json.dumps(values)).load()


def test_readers(spark):
    got = {(r.parent, r.child, r.error) for r in load(spark, "wiki_categories", ["C", "busy"]).collect()}
    assert got == {("C", "P1", None), ("C", "P2", None), ("busy", None, "status 429")}
    pages = load(spark, "wiki_pages", ["P1", "gone"]).collect()
    assert [(r.pageid, r.title, r.wikitext) for r in pages] == [(7, "P1", "text")]
    assert {(r.fighter, r.url, r.error) for r in load(spark, "news_search", ["ok", "bad"]).collect()} == {("ok", "u", None), ("bad", None, "status 500")}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "boards")
    assert snapshots.read_boards(spark, root).count() == 0
    s = stats(spark, [("a", 12, 0, 0, "i", None, 1)])
    snapshots.write_snapshot(ranking.board(s, "best"), root, "1")
    snapshots.write_snapshot(ranking.board(s.withColumn("wins", F.col("wins") + 1), "best"), root, "2")
    assert snapshots.load_board(spark, root, "best").first()["wins"] == 13
    assert snapshots.read_boards(spark, root, back=1).first()["wins"] == 12
    with pytest.raises(Exception):
        snapshots.write_snapshot(ranking.board(s, "best"), root, "2")
    doc = json.loads(snapshots.rankings_document(snapshots.read_boards(spark, root), "now").first()["json"])
    assert doc["fighters"][0]["name"] == "a" and "worst" not in doc and "gender" in doc["fighters"][0] and "previousRank" not in doc["fighters"][0]
    news = spark.createDataFrame([], snapshots.NEWS_ENTRY)
    assert not snapshots.write_news(news, str(tmp_path / "news"), "1") and snapshots.read_news(spark, str(tmp_path / "news")).count() == 0


@pytest.mark.parametrize("present", [["best", "worst", "secondaryWorst"], ["thirdary"], []])
def test_document_in_parts(spark, present):
    """Parts joined are the document as one text; read back, every entry stands at its place, also where ranks have gaps."""
    rows = spark.range(25).select(F.explode(F.array(*map(F.lit, ["none", *present]))).alias("board"), F.concat(F.lit('é,"]}\\\n'), "id").alias("name"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("wins"), (F.col("id") * 3 + 12).alias("rank"))
    parts = snapshots.document_parts(rows, 'the "day"', rows_per_part=10).orderBy("place", "part").collect()
    assert "".join(p["json"] for p in parts) == snapshots.rankings_document(rows, 'the "day"').first()["json"]
    assert all(p["json"].count('"name"') <= 10 for p in parts)
    back = snapshots.read_document(snapshots.document_parts(rows, "now", rows_per_part=10), "struct<name: string, wins: bigint>")
    want = {(b, i + 1, f'é,"]}}\\\n{i}', i if i % 2 == 0 else None) for b in present for i in range(25)}
    got = back.select("board", "rank", "r.*").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_a_broken_part_of_a_document_is_an_error(spark):
    parts = spark.createDataFrame([(0, 1, 0, '{"name":"a"'), (0, 2, 1, ',{"name":"b"}')], "place int, part long, before long, json string")
    with pytest.raises(Exception, match="MALFORMED"):
        snapshots.read_document(parts, "struct<name: string>").collect()
