import pytest
from pyspark.sql import functions as F

from rankweave.functions import text
from rankweave.functions.wikitext import image_url, infobox, parse_records, quality_wins, records, strip_markup, weight_class

BOX = """{{Infobox martial artist
| name = Test Fighter
| image = File:Test Fighter.jpg|thumb
| birth_date = {{birth date and age|1985|3|4|df=yes}}
| birth_place = [[Recife]], [[Brazil]]
| weight_class = [[Lightweight (MMA)|Lightweight]]
| mma_kowin = 5
| mma_subwin = 3
| mma_decwin = 4 (2 split)
| mma_koloss =
| mma_draw = 1
}}"""

TABLE = """intro
==Mixed martial arts record==
{{MMA record start}}
|-
|Win
|align=center|2-1
|[[Bob A]]
|KO
|-
|Loss
|align=center|1-1
|[[Carl]]
|Dec
|-
|Win
|align=center|1-0
|Nobody
|Sub
|- style=x
|Win
|c
|[[Dan]]
|KO
|-
|Loss
|0-1
|[[Eve]]
|Win Night
|-
|{{yes2}}Win
|c
|[[Bob A]]
|KO
==References==
|-
|Win
|x
|[[No]]
"""


def one(spark, expr, value):
    return spark.range(1).select(expr(F.lit(value).cast("string")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("[[Lightweight (MMA)|Lightweight]]", "Lightweight"), ("Lightweight, Featherweight", "Featherweight"), ("[[Welterweight]], Middleweight", "Middleweight"),
        ("Light-heavyweight", "Light heavyweight"), ("{{plainlist|\n* [[Bantamweight]]\n* [[Flyweight]]}}", "Bantamweight"), ("{{Plainlist|\n* [[Bantamweight]]}}", ""),
        ("155 lb", ""), ("70 kg (154 lb)", ""), ("Catchweight", "Catchweight"), ("Super flyweight", "Flyweight"), ("Open weight class", "Open weight"),
        ("[[Heavyweight]]<br>[[Light Heavyweight]]", "Light heavyweight"), ("", ""), (None, None),
    ],
)
def test_weight_class(spark, raw, expected):
    assert one(spark, weight_class, raw) == expected


def test_strip_markup(spark):
    raw = "'''[[New York City|NYC]]''', {{flag|US}} <ref name=\"a\">x</ref> U.S.&nbsp; fighter"
    assert one(spark, strip_markup, raw) == "NYC, U.S. fighter"
    assert one(spark, strip_markup, "") == "" and one(spark, strip_markup, None) is None


def test_names_and_addresses(spark):
    assert one(spark, text.encode_component, "A_b c+d!~*'()é&=%/?#,;:@$-._ü日") == "A_b%20c%2Bd!~*'()%C3%A9%26%3D%25%2F%3F%23%2C%3B%3A%40%24-._%C3%BC%E6%97%A5"
    assert one(spark, text.display_name, "Jon Doe (mixed martial artist)") == "Jon Doe"
    assert one(spark, text.display_name, "Jon Doe (fighter)") == "Jon Doe (fighter)"
    assert one(spark, text.search_name, "Jon Doe (fighter)") == "Jon Doe"
    assert one(spark, text.initials, "Jon Bones Jones") == "JB"
    got = spark.createDataFrame([(1, 8), (3, 8), (1, 3), (5, 8), (1, 200), (0, 0)], "k long, w long").select(text.ko_percent(F.col("k"), F.col("w")).alias("x")).collect()
    assert [r.x for r in got] == [13, 38, 33, 63, 1, 0]


def test_quality_wins(spark):
    assert one(spark, quality_wins, TABLE) == 3
    assert one(spark, quality_wins, "no table") == 0 and one(spark, quality_wins, None) == 0


def test_images(spark):
    base = "https://en.wikipedia.org/wiki/Special:FilePath/"
    assert one(spark, image_url, "[[File:A b.PNG|thumb]]") == base + "A_b.PNG"
    assert one(spark, image_url, "Image:x.jpg|200px") == base + "x.jpg"
    for bad in ("", "<!-- x.jpg", "a.txt", "Generic_belt_icon.svg", "Insert image.png"):
        assert one(spark, image_url, bad) == ""


def test_infobox_spans(spark):
    def scan(t):  # read by hand, mark by mark
        for p in ("{{Infobox martial artist", "{{Infobox person"):
            at = t.find(p)
            if at < 0:
                continue
            depth, i = 0, at
            while i < len(t) - 1:
                if t[i : i + 2] == "{{":
                    depth, i = depth + 1, i + 2
                elif t[i : i + 2] == "}}":
                    depth, i = depth - 1, i + 2
                    if not depth:
                        return t[at:i]
                else:
                    i += 1
        return None

    texts = ["x {{Infobox person|a={{b}}}} y", "{{Infobox martial artist {{Infobox person}} z", "{{Infobox person {{{a}}} }} b }}", "none", "", "{{Infobox martial artist}}{{Infobox person}}"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(infobox(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [scan(t) for t in texts]


def test_records(spark):
    no_loss = "\n".join(l for l in BOX.split("\n") if "loss" not in l and "draw" not in l)
    ko = "\n".join(l for l in BOX.split("\n") if "win" not in l).replace("| mma_koloss", "| ko = 7\n| mma_koloss")
    texts = {
        "full": BOX, "no_loss": no_loss, "ko": ko, "total": BOX.replace("| mma_draw", "| total = 20\n| mma_draw"), "open": BOX[:-2], "empty": "", "null": None,
        "multi": BOX.replace("[[Lightweight (MMA)|Lightweight]]", "{{plainlist|\n* [[Bantamweight]]\n* [[Flyweight]]}}").replace("birth_place", "nationality = American\n| birth_place"),
        "later": BOX.replace("mma_koloss =", "mma_kowin = 9\n| mma_koloss = 2"),
    }
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {r.id: r for r in parse_records(df, "text").collect()}
    a = got["full"]
    assert (a.wins, a.kos, a.losses, a.draws, a.total, a.nationality, a.weightClass, a.birthDate, a.qualityWins) == (12, 5, 0, 1, 13, "Brazil", "Lightweight", "1985", 0)
    assert a.imageUrl == "https://en.wikipedia.org/wiki/Special:FilePath/Test_Fighter.jpg"
    assert got["no_loss"].losses is None
    assert (got["ko"].wins, got["ko"].kos) == (0, 0)
    assert got["total"].total == 20
    assert got["open"].wins is None
    assert (got["multi"].weightClass, got["multi"].nationality) == ("Bantamweight", "American")
    assert (got["later"].wins, got["later"].losses) == (16, 2)
    assert {r.id for r in records(df, "text").select("id").collect()} == {"full", "ko", "total", "multi", "later"}
