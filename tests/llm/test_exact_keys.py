"""Identifiers above 2**53 beside null ones come through exactly."""

import os

import pytest

from rankweave.llm.canon import map_to_list
from rankweave.llm.leakage import leaked_passages
from rankweave.llm.lookalike import look_alike_classes
from rankweave.llm.packing import VOCABULARY, pack_texts
from rankweave.operators.multivalue import split_values

BIG = 2**62 + 1


def test_keys(spark):
    df = spark.createDataFrame([(BIG, "a, b c d"), (None, "a, b c d")], "id long, text string")
    assert {r.row_key for r in split_values(df, "id", "text").collect()} == {BIG, None}
    items = spark.createDataFrame([(BIG, "a b c d")], "id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaked_passages(df, items, "id", "text", "id", "text", 4).collect()} == {(BIG, BIG), (None, BIG)}
    listed = {"text": spark.createDataFrame([(1, "x")], "ord long, name string")}
    aliases = spark.createDataFrame([], "field string, alias string, canon_ord long")
    assert {r.id for r in map_to_list(df, "id", listed, aliases).collect()} == {BIG, None}
    assert {r.id for r in look_alike_classes(df, "id", "text").collect()} == {BIG}
    if os.path.exists(VOCABULARY):
        assert {r.id for r in pack_texts(df, "id", "text", "text").collect()} == {BIG, None}
    else:
        pytest.skip("no vocabulary here")
