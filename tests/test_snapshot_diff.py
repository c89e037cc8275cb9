import random

import pytest

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankweave.operators.snapshot_diff import changes_in_order, chunk_changes, snapshot_changes

SCHEMA = "s int, k long, at timestamp, v long, w string, step string, key string"


def brute(rows):
    state = {}
    for s, k, at, v, w, *_ in rows:
        if s is not None and k is not None:
            old = state.setdefault(s, {}).get(k)
            if old is None or (at is not None, at or 0) > (old[0] is not None, old[0] or 0):
                state[s][k] = (at, v, w)
    out = set()
    ids = sorted(state)
    for a, b in zip(ids, ids[1:]):
        x, y = state[a], state[b]
        out |= {(b, k, "added") for k in y.keys() - x.keys()} | {(b, k, "removed") for k in x.keys() - y.keys()}
        out |= {(b, k, "changed") for k in x.keys() & y.keys() if x[k][1:] != y[k][1:]}
    return out


@pytest.mark.parametrize("mean, spread", [(64, 1), (3, 1), (4, 10**12)])
def test_against_brute_force(spark, mean, spread):
    import datetime as dt

    rng = random.Random(mean)
    rows, alive = [], {k * spread - 50: (k, "x") for k in range(300)}
    day = dt.datetime(2024, 1, 1)
    for s in (3, 4, 9, 20):
        for k in list(alive):
            if rng.random() < 0.03:
                del alive[k]
            elif rng.random() < 0.05:
                alive[k] = (rng.choice([None, rng.randrange(9)]), rng.choice([None, "a", ""]))
        for _ in range(rng.randrange(8)):
            alive[rng.randrange(300) * spread] = (1, "new")
        for k, (v, w) in alive.items():
            rows.append((s, k, day + dt.timedelta(days=s), v, w, "p", None))
            if rng.random() < 0.1:
                rows.append((s, k, day, 77, "old", "p", None))  # an older state
            if rng.random() < 0.1:
                rows.append(rows[-1] if rows[-1][3] != 77 else rows[-2])
    rows += [(None, 1, day, 1, "", None, None), (3, None, day, 1, "", None, None)]
    rng.shuffle(rows)
    got = [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA), "s", "k", "at", ["v", "w"], mean).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_edges(spark):
    one = spark.createDataFrame([(1, 1, None, 1, "a", "", "")], SCHEMA)
    assert snapshot_changes(one, "s", "k", "at", ["v"]).count() == 0
    assert snapshot_changes(one.limit(0), "s", "k", "at", ["v"]).count() == 0


def test_one_far_key_leaves_ranges_and_chunks_even(spark):
    keys = spark.range(20_000).unionByName(spark.range(2**50, 2**50 + 1))
    rows = keys.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("s"), F.col("id").alias("k"), F.lit(0).alias("at"), F.col("id").alias("v"))
    sizes = rows.repartitionByRange(8, "k").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2 * 40_002 / 8
    rows = rows.unionByName(spark.createDataFrame([(2, 5, 1, 77), (2, 30_000, 0, 1)], "s int, k long, at int, v long"))
    assert {tuple(r) for r in snapshot_changes(rows, "s", "k", "at", ["v"]).collect()} == {(2, 5, "changed"), (2, 30_000, "added")}


def test_only_differing_chunks_are_joined():
    n = 10_000
    key = np.repeat(np.arange(n), 2)
    rows = {"snap": np.tile([1, 2], n), "key": key, "d1": key * 3, "d2": key * 5}
    rows["d1"][2 * 4321 + 1] = -1
    step, keys, kind, joined = chunk_changes(rows, key // 64, np.array([1, 2]))
    assert (step.tolist(), keys.tolist(), kind.tolist(), joined) == ([2], [4321], [2], 1)


def test_batches_of_any_length_give_the_same():
    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 3000, 6000))
    snap = rng.integers(0, 4, 6000)
    keep = np.unique(np.stack([key, snap]), axis=1)
    key, snap = keep
    table = pa.table({"snap": snap, "key": key, "d1": key + rng.integers(0, 2, len(key)), "d2": key, "edge": (key % 13 == 0).astype(np.int64)})
    got = [sorted(zip(*(pa.Table.from_batches(changes_in_order(iter(table.to_batches(max_chunksize=m)), np.arange(4))).to_pydict().values()))) for m in (1, 7, 500, 9999)]
    assert got[0] == got[1] == got[2] == got[3] and got[0]


def test_null_and_another_column_with_the_value_differ(spark):
    rows = spark.createDataFrame([(1, 1, 0, 5, None), (2, 1, 0, None, 5)], "s int, k long, at int, v long, w long")
    assert [r.change_kind for r in snapshot_changes(rows, "s", "k", "at", ["v", "w"]).collect()] == ["changed"]
