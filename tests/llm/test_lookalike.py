import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from rankweave.llm.lookalike import UNSEEN, Transducer, consistent, consistent_text, look_alike_classes, look_alike_links, look_alike_pairs, transducer


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ａｂ１！", "Ab1!"), ("é", "é"), ("e​́x", "éx"), ("a b c　d", "a b c d"), ("a​b⁠c﻿d­", "abcd"),
        ("сору", "copy"), ("ёё", "ëë"), ("йй", "йй"), ("29‐28‑30", "29-28-30"), ("ạ́", "ạ́"), ("ạ́", "ạ́"),
        ("ﬁx", "fix"), ("Å", "Å"), ("a\r\nb\rc d", "a\nb\nc\nd"), ("ｶﾞ", "ガ"), ("", ""), ("plain", "plain"), ("́", "́"), ("ά", "ά"),
        ("\U0001f468‍\U0001f469", "\U0001f468‍\U0001f469"),
    ],
)
def test_forms(text, want):
    assert consistent(text) == want


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aeео̣́̈​‍ａéё  ")), max_size=30))
def test_forms_are_stable_and_ignore_composition(text):
    form = consistent(text)
    assert consistent(form) == form
    assert consistent(unicodedata.normalize("NFC", text)) == consistent(unicodedata.normalize("NFD", text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(categories=["Lu", "Ll", "Mn", "Lo"]), st.sampled_from("aeêqo\u0323\u0301\u0302\u0308\u0327가각\u1100\u1161\u11a8")), max_size=12))
def test_accents_and_syllables_as_the_standard_composes_them(text):
    mapped = set(map(ord, text)) & (transducer().single.keys() | set(UNSEEN))
    if not mapped and not any(ord(c) in transducer().single for c in unicodedata.normalize("NFD", text)):
        assert consistent(text) == unicodedata.normalize("NFC", text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aé\u0301\u200d가\u1161👩💻\r\n")), max_size=15))
def test_clusters_are_the_standard_ones(text):
    text = "".join(c for c in text if ord(c) not in UNSEEN or c == "\u200d")
    starts, at = set(), 0
    for x in regex.findall(r"\X", text):
        starts.add(at)
        at += len(x)
    t = transducer()
    ends = starts | {len(text)}
    for begin, end in t.clusters(text, t.kind[list(map(ord, text))]):
        assert begin in starts or regex.match(r"\p{GCB=Prepend}|\p{GCB=L}|[\U0001f1e6-\U0001f1ff]", text[begin - 1])
        assert end in ends or regex.match(r"\p{GCB=Prepend}|\p{GCB=L}", text[end - 1]) or text[end - 1] == "\u200d"


@pytest.mark.parametrize("c", "\u202a\u202e\u2066\u2069\u061c\U000e0100\u3164")
def test_unseen_controls(c):
    assert consistent(f"a{c}b") == "ab"


@pytest.mark.parametrize("text, want", [("ᎪᏴ", "AB"), ("ꓮꓐ", "AB"), ("ⲞⲢ", "OP"), ("У", "Y"), ("ԍ", "ɢ"), ("Ь", "b"), ("2\u22121", "2-1"), ("a\u1680b", "a b"), ("각", "각"), ("q\u0301\u0323", "q\u0323\u0301")])
def test_more_scripts(text, want):
    assert consistent(text) == want


def test_what_looks_different_stays_different():
    for a, b in (("e", "é"), ("a", "A"), ("1", "2"), ("и", "й"), ("a b", "ab"), ("a  b", "a b")):
        assert consistent(a) != consistent(b)


def test_conflicts_are_refused():
    with pytest.raises(ValueError):
        Transducer({"x": "y", "y": "x"})


def test_pairs_and_classes(spark):
    rows = [(1, "ab"), (2, "аb"), (3, "ab"), (4, "a​b"), (5, "AB"), (6, ""), (7, "​"), (8, None), (9, ""), (2, "аb"), (None, "ab"), (10, "z" * 100_000 + "о"), (11, "z" * 100_000 + "o")]
    rows += [(100 + i, "hot text" if i % 10 == 0 else "hot text") for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, form string")
    texts = {i: t for i, t in rows if i is not None and t is not None}
    want = {(a, b) for a in texts for b in texts if a < b and texts[a] != texts[b] and consistent(texts[a]) == consistent(texts[b])}
    for hot, block in ((10**6, 2000), (5, 7)):
        got = [tuple(r) for r in look_alike_pairs(df, "id", "text", hot, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        classes = {r.id: (r.class_id, r.members, r.variants) for r in look_alike_classes(df, "id", "text", hot).collect()}
        assert classes[3] == (1, 4, 3) and classes[5] == (5, 1, 1) and classes[9] == (6, 3, 2) and classes[159] == (100, 60, 2) and 8 not in classes
    links = sorted(tuple(r) for r in look_alike_links(df, "id", "text").collect())
    assert links == [(1, 2, 1), (1, 4, 1), (6, 7, 1), (10, 11, 1), (100, 101, 54)]
    assert look_alike_links(df.limit(0), "id", "text").count() == 0
    assert look_alike_pairs(df.limit(0), "id", "text").count() == 0
    forms = {r.id: r.out for r in consistent_text(df, "text", "out").where("id in (2, 8)").collect()}
    assert forms == {2: "ab", 8: None}
