import random

import pytest

from rankweave.operators.multivalue import FieldGrammar, split_values

NAMES = ["Trinidad and Tobago", "Antigua and Barbuda", "Bosnia and Herzegovina", "Peru"]


def items(text, names=NAMES):
    return [i for _, i, _ in FieldGrammar(names).parse(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Peru", ["Peru"]), ("Peru, Chile", ["Peru", "Chile"]), ("Peru, and Chile", ["Peru", "Chile"]), ("; Peru ;; Chile |", ["Peru", "Chile"]),
        ("Antigua and Barbuda and Peru", ["Antigua and Barbuda", "Peru"]), ("trinidad and tobago & x", ["trinidad and tobago", "x"]), ("Poland and Finland", ["Poland", "Finland"]),
        ('"Gambia, The"/Peru', ["Gambia, The", "Peru"]), ("'Congo, D. R. of the', Côte d'Ivoire", ["Congo, D. R. of the", "Côte d'Ivoire"]), ("“a, b” • c", ["a, b", "c"]),
        ("Italy (2008, 2010); Peru", ["Italy (2008, 2010)", "Peru"]), ('"Italy" (2008, 2010)', ["Italy (2008, 2010)"]), ("x (a (b, c), d), e", ["x (a (b, c), d)", "e"]),
        ("[[A (x)|B, c]]<br />[[D]]", ["B, c", "D"]), ("{{plainlist|\n* [[A|B]]\n* C (1; 2 and 3)\n}}", ["B", "C (1; 2 and 3)"]), ("{{ubl|A | B}}", ["A", "B"]), ("{{Hlist|[[X|Y]]|Z}}", ["Y", "Z"]),
        ("Light-heavyweight / Guinea-Bissau", ["Light-heavyweight", "Guinea-Bissau"]), ("A\n B<BR/>C", ["A", "B", "C"]), ("A&nbsp;B, C", ["A B", "C"]), ("A<ref>x, y</ref>, B", ["A", "B"]),
        ("A, A", ["A", "A"]), ("", []), (None, []), (" , ;", []), ("* A\n* B", ["A", "B"]), ("'''A''', B", ["A", "B"]), ("Peruandes, sand and", ["Peruandes", "sand and"]),
    ],
)
def test_grammar(text, want):
    assert items(text) == want


def test_errors_are_flagged_and_parsed_on():
    g = FieldGrammar()
    assert g.parse('"a, b') == [(1, '"a', "malformed_quote"), (2, "b", None)]
    assert g.parse('"a"b, c') == [(1, '"a"b', "malformed_quote"), (2, "c", None)]
    assert g.parse("x (a, b") == [(1, "x (a", "open_bracket"), (2, "b", None)]


def test_round_trip():
    rng = random.Random(5)
    atoms = ["Peru", '"a, b"', "c (1, 2)", "[[d|e, f]]", "Antigua and Barbuda", "g-h", "é à"]
    shown = ["Peru", "a, b", "c (1, 2)", "e, f", "Antigua and Barbuda", "g-h", "é à"]
    for _ in range(500):
        picked = [rng.randrange(len(atoms)) for _ in range(rng.randrange(1, 7))]
        sep = rng.choice([", ", ";", " | ", "/", " & ", "<br>", "\n", " • ", ", and "])
        assert items(sep.join(atoms[k] for k in picked)) == [shown[k] for k in picked]


def test_operator(spark):
    rows = [(1, "A, B", "x"), (1, "A, B", "y"), (2, "single", "x"), (3, None, None), (4, "", ""), (None, "C; D", "x"), (5, "z" * 50_000 + ", end", "x")]
    df = spark.createDataFrame(rows, "row_key long, field string, item string")  # names as the operator's own
    got = sorted(map(tuple, split_values(df, "row_key", "field", NAMES, 2).select("row_key", "pos", "item").collect()), key=str)
    assert got == sorted([(1, 1, "A"), (1, 2, "B"), (None, 1, "C"), (None, 2, "D"), (5, 1, "z" * 50_000), (5, 2, "end")], key=str)
    assert split_values(df, "row_key", "field").where("row_key = 2").count() == 1
    assert split_values(df.limit(0), "row_key", "field").count() == 0
    with pytest.raises(ValueError):
        split_values(df, "row_key", "field", map(str, range(20_000)))
