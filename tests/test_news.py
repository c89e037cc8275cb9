from pyspark.sql import functions as F

from rankweave.operators import discovery, news

ARTICLE = "seq int, fighter string, title string, description string, url string, source string, publishedAt string"
ENTRY = "seq int, boxerName string, headline string, url string, source string, publishedAt string"


def test_matching(spark):
    watched = spark.createDataFrame([("A One", 2), ("B Two (fighter)", 1)], "name string, rank long")
    rows = [
        (1, "A One", "b two wins", None, "u1", None, "d"),  # fetched for A, mentions only B
        (2, "A One", "A one meets B Two", None, "u2", "S", "d"),  # own name first
        (3, "A One", "nobody", None, "u3", "S", "d"), (4, "A One", "nobody", "but a ONE", "u3", "S", "d"),  # the second copy is kept
        (5, "A One", "A One", None, None, "S", "d"), (6, None, None, None, "u4", "S", "d"),
    ]
    got = news.link_articles(spark.createDataFrame(rows, ARTICLE), watched, [F.col("seq")]).collect()
    assert {(r.url, r.boxerName, r.source) for r in got} == {("u1", "B Two (fighter)", "News"), ("u2", "A One", "S"), ("u3", "A One", "S")}


def test_merge_and_anti(spark):
    new = spark.createDataFrame([(1, "a", "h", "u", "s", "2023-01-01"), (2, "a", "h2", None, "s", None), (3, "a", "h2", "", "s", None)], ENTRY)
    old = spark.createDataFrame([(1, "a", "h", "u", "s", "2023-06-01"), (2, "a", "x", "v", "s", "2023-06-01")], ENTRY)
    merged = news.rolling_merge(new, old, "2023-02-01")
    assert {(r.url, r.headline, r.publishedAt) for r in merged.collect()} == {("u", "h", "2023-06-01"), ("v", "x", "2023-06-01"), (None, "h2", None)}
    again = news.rolling_merge(merged, merged, "2023-02-01")
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))
    assert news.new_since(merged, merged).count() == 0
    assert {r.url for r in news.new_since(merged, old.where("url = 'v'")).collect()} == {"u", None}
    assert news.digest_lines(merged.where("url is null")).first()["line"] == "- h2 [s, ?] "


def test_discovery(spark):
    m, f, e = (f"Category:{g}ixed martial artists by nationality" for g in ("Male m", "Female m", "M"))
    edges = [
        (m, "c1", "subcat"), (f, "c2", "subcat"), (e, "c3", "subcat"), (e, "c4 Olympic", "subcat"), ("c1", "both", "page"), ("c2", "both", "page"), ("c1", "man", "page"),
        ("c3", "extra", "page"), ("c3", "List of X", "page"), ("c1", "Category:X", "page"), ("c4 Olympic", "no", "page"), ("c3", "c3 by state", "subcat"), ("c3", "c3 other", "subcat"),
        ("c3 by state", "c3 TX", "subcat"), ("c3 TX", "deep", "page"), ("c3 other", "not deep", "page"), ("c2", "both", "page"), ("c1", "Lists of c1", "subcat"), ("Lists of c1", "listed", "page"),
    ]
    df = spark.createDataFrame(edges, "parent string, child string, kind string")
    assert {(r.title, r.gender) for r in discovery.all_pages(df).collect()} == {("both", "female"), ("man", "male"), ("extra", "male"), ("deep", "male")}
    assert discovery.all_pages(df.limit(0)).count() == 0
