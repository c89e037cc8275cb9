import itertools
import random

import pytest

from rankweave.llm.canon import Reference, deletions, distance, fold, map_to_list, peoples

COUNTRIES = [(1, "Brazil"), (2, "São Tomé and Príncipe"), (3, "United States"), (4, "Mali"), (5, "Malta"), (6, "Norway")]
ALIASES = [("Brazilian", 1), ("USA", 3), ("U.S.", 3), ("American", 3), ("Malian", 4)]


@pytest.fixture(scope="module")
def ref():
    return Reference(COUNTRIES, ALIASES, {4: 10, 5: 1})


@pytest.mark.parametrize(
    "value, want",
    [
        ("brazil", 1), ("BRAZIL;", 1), ("Brzil", 1), ("Brazill", 1), ("Barzilian", 1), ("from Brazil", 1), ("born in Brazil", 1), ("Brazil (since 2012)", 1), ("Recife, Brazil", 1),
        ("[[Brazil]]<ref/>", 1), ("{{flag|Brazil}}", 1), ("'''Brazil'''", 1), ("Brazil&nbsp;", 1), ("- Brazil", 1), ("Brazilian citizen", 1), ("Sao Tome and Principe", 2), ("são tomé and prícnipe", 2),
        ("usa", 3), ("U.S", 3), ("us", 3), ("uzz", 0), ("Brazil (Brazilian)", 1), ("none", 0), ("Unknown", 0), ("?", 0), ("", 0), ("254 lbs", 0), ("Zhanfanodroun Islands", 0), ("Mali", 4), ("Malt", 4), ("x" * 100, 0), ("[[Brazil]]<ref>" + "long " * 900 + "</ref>", 1), ("a, b, c, Brazil", 1), ("," * 3000, 0), ("a, " * 2000, 0),
    ],
)
def test_readings(ref, value, want):
    assert ref.lookup(value) == want


def test_ties_go_to_the_more_frequent_entry():
    r = Reference([(1, "abcdex"), (2, "abcdey")], [], {2: 5})
    assert r.lookup("abcdew") in (1, 2)
    even = Reference([(1, "abcdem"), (2, "abcdep")], [], {2: 5})
    assert even.lookup("abcdeq") == 2 and Reference([(1, "abcdem"), (2, "abcdep")], [], {1: 5}).lookup("abcdeq") == 1


def test_index_finds_all_that_a_scan_finds(ref):
    rng = random.Random(2)
    terms = [t for t in ref.exact if len(t) >= ref.short]
    for _ in range(400):
        t = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = rng.choice("abxyz" + t[k])
        bare = "".join(t)
        near = [(distance(bare, x), -ref.frequency.get(ref.exact[x], 0), ref.exact[x]) for x in terms if distance(bare, x) <= ref.edits(min(len(x), len(bare)))]
        got = ref.nearest(bare)
        if near and len(bare) >= ref.short:
            assert got is not None and abs(got[0] - min(near)[0]) < 1e-9 and got[1] == min(near)[2]


def test_distance_and_deletions():
    assert distance("abcd", "abcd") == 0 and distance("abcd", "abdc") == 0.7 and distance("aabc", "abc") == 0.6 and distance("a", "z") <= 1
    assert distance("gold", "golf") == distance("golf", "gold") == 0.7
    for a, b in itertools.product(["", "a", "ab", "ba"], repeat=2):
        assert (distance(a, b) == 0) == (a == b)
    assert deletions("abc", 1) == {"abc", "ab", "ac", "bc"} and fold("Ünited-States!") == "unitedstates"


def test_operator(spark):
    rows = [(1, "Brazil", "x", 1), (2, "brasil", "x", 1), (2, "brasil", "x", 1), (3, None, "x", 1), (4, "", "x", 1), (None, "nowhere land", "x", 1), (5, "from Mali " + "," * 5000, "x", 1)]
    df = spark.createDataFrame(rows, "rec_id long, nationality string, field string, canon_ord int")
    lists = {"nationality": spark.createDataFrame(COUNTRIES, "ord int, country string")}
    aliases = spark.createDataFrame([("nationality", a, o) for a, o in ALIASES], "field string, alias string, canon_ord int")
    got = {(r.rec_id, r.canon_ord, r.is_entry) for r in map_to_list(df, "rec_id", lists, aliases).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, 0, False), (5, 4, False)}
    assert map_to_list(df, "rec_id", lists, aliases).count() == 5
    none = {"nationality": lists["nationality"].limit(0)}
    assert {r.canon_ord for r in map_to_list(df, "rec_id", none, aliases.limit(0)).collect()} == {0}
    assert map_to_list(df.limit(0), "rec_id", lists, aliases).count() == 0


@pytest.mark.parametrize("place, people", [
    ("Panama", "Panamanian"), ("Venezuela", "Venezuelan"), ("Peru", "Peruvian"), ("Hungary", "Hungarian"), ("Morocco", "Moroccan"), ("Scot", "Scottish"), ("England", "English"),
    ("Slovenia", "Slovene"), ("New Zealand", "New Zealander"), ("Trinidad and Tobago", "Trinidadian"), ("Dominican Republic", "Dominican"), ("Costa Rica", "Costa Rican"), ("Dutch", "Dutchman"),
])
def test_people_by_rule(place, people):
    assert fold(people) in peoples(place)
    assert Reference([(7, place)], [], {}, True).lookup(people) == 7 or fold(people) == fold(place)


def test_derived_forms_give_way_to_listed_ones():
    r = Reference([(1, "Niger"), (2, "Nigeria")], [("Nigerian", 2), ("Nigerien", 1), ("RSA", 1)], {}, True)
    assert r.lookup("Nigerian") == 2 and r.lookup("nigerien") == 1 and "rsaian" not in r.derived
    assert not set(r.derived) & set(r.exact)


def test_large_lists_are_joined_to_the_same_rows(spark):
    rng = random.Random(8)
    typed = [x for x, _ in [("brazil", 1), ("Brzil", 1), ("Barzilian", 1), ("from Brazil", 1), ("Recife, Brazil", 1), ("usa", 3), ("us", 3), ("none", 0), ("?", 0), ("254 lbs", 0), ("Mali", 4), ("Malt", 4), ("Norwayan", 6), ("Norwayn", 6)]]
    for name, _ in ALIASES + [(n, o) for o, n in COUNTRIES]:
        for _ in range(6):
            k = rng.randrange(len(name))
            typed.append(name[:k] + rng.choice("aeioux") + name[k + rng.randrange(2):])
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*typed, None, "", *["Mali"] * 30])], "rec_id long, nationality string")
    lists = {"nationality": spark.createDataFrame(COUNTRIES, "ord int, country string")}
    aliases = spark.createDataFrame([("nationality", a, o) for a, o in ALIASES], "field string, alias string, canon_ord int")
    small, large = ({tuple(r) for r in map_to_list(df, "rec_id", lists, aliases, ("nationality",), n).collect()} for n in (1000, 3))
    assert small == large and len(small) == len(typed) + 30
