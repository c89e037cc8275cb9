from pyspark.sql import functions as F

from rankweave.operators import discovery
from rankweave.operators.keyed import meet

EDGES = "parent string, child string, kind string"


def test_prefixes_and_excluded_categories(spark):
    titles = [*(p + "x" for p in discovery.NOT_PAGES), "Fine", "Lists", "category:x", "A List of"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r.t for r in df.where(discovery.is_entity_page(F.col("t"))).collect()} == {"Fine", "Lists", "category:x", "A List of"}
    cats = [*(f"American{p}" for p in discovery.EXTRA_EXCLUDES), "American mixed martial artists", "female mixed martial artists"]
    df = spark.createDataFrame([(t,) for t in cats], "t string")
    assert {r.t for r in df.where(discovery.is_extra_country(F.col("t"))).collect()} == set(cats[-2:])


def test_levels(spark):
    edges = spark.createDataFrame([
        ("r", "p0", "page"), ("r", "s", "subcat"), ("r", "Lists of s", "subcat"), ("r", "r by state", "subcat"), ("r", "r", "page"), ("r", "p0", "page"),
        ("s", "p1", "page"), ("Lists of s", "no", "page"), ("s", "t", "subcat"), ("t", "too deep", "page"), ("s", "Template:x", "page"),
        ("r by state", "p2", "page"), ("r by state", "ohio", "subcat"), ("ohio", "p3", "page"), ("ohio", "cities", "subcat"), ("cities", "far", "page"), ("r by state", "Lists of states", "subcat"), ("Lists of states", "no2", "page"),
    ], EDGES)
    root = spark.createDataFrame([("R", "r"), ("N", "none")], "root string, at string")
    assert {tuple(x) for x in discovery.category_pages(root, edges).collect()} == {("R", t) for t in ("p0", "r", "p1", "p2")}
    assert {tuple(x) for x in discovery.category_pages_deep(root, edges).collect()} == {("R", t) for t in ("p0", "r", "p2", "p3")}
    assert discovery.category_pages(root, edges.limit(0)).count() == 0


def test_female_before_male_before_further_countries(spark):
    edges = spark.createDataFrame([
        ("F by nationality", "f", "subcat"), ("M by nationality", "m", "subcat"), ("E by nationality", "e", "subcat"), ("E by nationality", "e Olympic", "subcat"),
        ("f", "both", "page"), ("m", "both", "page"), ("m", "him", "page"), ("e", "other", "page"), ("e", "both", "page"), ("e Olympic", "out", "page"),
    ], EDGES)
    pages = discovery.all_pages(edges, "M", "F", "E")
    assert {tuple(r) for r in pages.collect()} == {("both", "female"), ("him", "male"), ("other", "male")}
    known = spark.createDataFrame([("both", "old"), ("stranger", "old"), (None, "old")], "name string, gender string")
    assert {tuple(r) for r in discovery.attach_gender(known, pages).collect()} == {("both", "female"), ("stranger", None), (None, None)}


def test_hot_keys_meet_all_their_rows(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)], "k string, v int")
    want = sorted(tuple(r) for r in rows.join(few, "k").collect())
    assert len(want) == 1208
    for hot_rows, broadcast_rows in ((10**6, 10**6), (100, 1), (10**6, 1)):
        assert sorted(tuple(r) for r in meet(rows, few, "k", hot_rows, 4, broadcast_rows).collect()) == want
