import random

import numpy as np
import pytest

from rankweave.llm.leakage import FMIndex, Pass, WaveletMatrix, _located, leaked_passages, scan_shards, suffix_array, words, write_passes


@pytest.mark.parametrize("seed", range(40))
def test_index_against_scan(seed):
    rng = random.Random(seed)
    size = rng.choice([2, 3, 5, 9, 3000])
    seq = np.array([rng.randrange(min(size, 4) if seed % 2 else size) for _ in range(rng.randrange(1, 120))] + [0], dtype=np.int32)
    if seed % 3 == 0:
        seq = np.concatenate([seq, seq, seq]).astype(np.int32)
    index = FMIndex(seq, size, 4)
    length = rng.randrange(1, 6)
    phrases = [[rng.randrange(1, size) for _ in range(length)] for _ in range(15)] + [seq[k : k + length].tolist() for k in range(len(seq) - length) if (seq[k : k + length] > 0).all()]
    begin, end = index.search(np.array(phrases, dtype=np.int64))
    for p, b, e in zip(phrases, begin, end):
        assert sorted(index.locate(np.arange(b, e)).tolist()) == [k for k in range(len(seq) - length + 1) if seq[k : k + length].tolist() == p]


def test_parts():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 11, 200).astype(np.int32)
    w = WaveletMatrix(seq, 11)
    at = np.arange(201)
    for c in range(11):
        assert w.rank(np.full(201, c), at).tolist() == [int((seq[:k] == c).sum()) for k in at]
    symbol, rank = w.access(np.arange(200))
    assert symbol.tolist() == seq.tolist() and rank.tolist() == [int((seq[:k] == seq[k]).sum()) for k in range(200)]
    assert sorted(suffix_array(seq, 11).tolist()) == list(range(200))
    assert words("A-b, c­d\n É_f　９") == ["a", "b", "cd", "é", "f", "９"] and words("") == []


def test_shards_and_spans_against_scan():
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 12)))) for k in range(12)] + [(99, None), (98, "")]
    docs = [(k, " ".join(rng.choice("abcdefghxyz") for _ in range(rng.randrange(60)))) for k in range(60)] + [(7, "a b c d " * 200)]
    for shard in (10, 37, 10_000):
        passes = [Pass.of(items[k::3]) for k in range(3)]
        got = [tuple(x) for f in scan_shards(iter(docs), lambda: passes, 4, shard) for x in f.itertuples(index=False)]
        want = set()
        for d, t in docs:
            w = t.split()
            for i, s in items:
                v = (s or "").split()
                runs = {tuple(v[k : k + 4]) for k in range(len(v) - 3)}
                want |= {(d, i, k) for k in range(len(w) - 3) if tuple(w[k : k + 4]) in runs}
        assert {(d, i, k) for d, i, a, b in got for k in range(a, b - 3)} == want


def test_operator(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [
        (1, f"x ONE, two-three\nfour five six; seven eight nine ten eleven twelve! y", "a"), (2, "one two three four five six seven eight nine ten eleven", "a"), (3, None, "a"), (4, "", "a"),
        (5, "z " * 30_000 + item, "a"), (5, "z " * 30_000 + item, "a"), (None, item, "a"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, item), (11, item), (12, "too short"), (13, None), (None, item)], "item_id long, text string")
    for limit in (2_000_000, 10):
        got = {tuple(r) for r in leaked_passages(df, items, "doc_id", "text", "item_id", "text", 12, 1000, limit).collect()}
        assert got == {(1, 10, 1, 13), (1, 11, 1, 13), (5, 10, 30000, 30013), (5, 11, 30000, 30013), (None, 10, 0, 13), (None, 11, 0, 13)}
    assert leaked_passages(df.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert leaked_passages(df, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_a_phrase_of_many_items_comes_in_blocks():
    seq = np.array([1, 2, 3, 1, 2, 3, 0], dtype=np.int32)
    index = FMIndex(seq, 4)
    phrases, of = np.tile([[1, 2]], (50, 1)), np.repeat(np.arange(25), 2)
    blocks = list(_located(index, phrases, of, block=8))
    assert len(blocks) > 5 and all(len(at) <= 10 for at, _ in blocks)
    assert sorted((i, a) for at, it in blocks for a, i in zip(at.tolist(), it.tolist())) == [(i, a) for i in range(25) for a in (0, 3)]


def test_driver_holds_no_items_however_many_passes(spark, tmp_path):
    import tracemalloc

    items = spark.range(4000).selectExpr("id", "concat('w', id, ' ', repeat(concat('x', id % 97, ' y', id, ' '), 20)) as t")
    tracemalloc.start()
    peaks = []
    for k, words_ in enumerate((10**9, 8_200)):
        tracemalloc.reset_peak()
        n = write_passes(items, str(tmp_path / str(k)), words_)
        peaks.append((n, tracemalloc.get_traced_memory()[1]))
    tracemalloc.stop()
    assert peaks[0][0] == 1 and peaks[1][0] >= 20 and abs(peaks[1][1] - peaks[0][1]) < 1_000_000
    docs = items.selectExpr("id", "concat('a b c ', t) as text")
    found = {n: leaked_passages(docs, items, "id", "text", "id", "t", 12, 5000, n) for n in (10**9, 8_200)}
    assert found[10**9].count() == 4000 and found[10**9].exceptAll(found[8_200]).count() == 0
