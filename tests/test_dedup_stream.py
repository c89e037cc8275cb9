import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators.keyed import attach, newest
from rankweave.streaming.dedup import ENTRY, SeenStore, dedupe_stream, land, merge_entries, surplus_deliveries

SCHEMA = "delivery_id long, received_at timestamp, url string, headline string, source string, at string, id string"


def brute(rows):
    by = {}
    for r in rows:
        key = ("u", r[2]) if r[2] else ("f", r[3] or "", r[4] or "")
        by.setdefault(key, set()).add((r[1] is None, r[1] or dt.datetime.min, r[0]))
    return {x[2] for v in by.values() for x in sorted(v)[1:]}, {sorted(v)[0][2] for v in by.values()}


def rows_of(n, seed=3):
    """Deliveries over 2,000 hours with one hot message, undated ones and missing urls."""
    rng = random.Random(seed)
    day, rows = dt.datetime(2024, 1, 1), []
    for i in range(n):
        k = rng.choice([0, 0, 0, rng.randrange(60)])
        at = day + dt.timedelta(hours=rng.randrange(2000)) if rng.random() < 0.95 else None
        url = f"u{k}" if k % 3 else rng.choice([None, ""])
        rows.append((i, at, url, rng.choice(["h", "h2"]) if not url else f"h{i}", rng.choice([None, ""]) if k % 2 else "s", "x", "y"))
    return rows


def stream(spark, store, rows, path, files):
    """Appends ``rows`` to the folder and runs the stream over what is new there, a file at a time."""
    df = spark.createDataFrame(rows, SCHEMA)
    land(df.withColumn("nr", F.monotonically_increasing_id()), ["nr"], files, f"{path}/{len(rows)}")
    source = store.session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    q = dedupe_stream(source, store, "url", ["headline", "source"], "received_at", "delivery_id")
    q.awaitTermination()
    return sum(1 for p in q.recentProgress if p["numInputRows"])


@pytest.mark.parametrize("horizon", ["1 hour", "1000 days"])
def test_batches_late_rows_and_expiry(spark, tmp_path, horizon):
    rows = rows_of(400)
    store = SeenStore(spark, f"file://{tmp_path}/store", horizon, stores=2, buckets=2)
    path = str(tmp_path / "in")
    assert stream(spark, store, rows, path, 4) >= 3
    surplus, kept = brute(rows)
    assert sorted(r.id for r in store.surplus().collect()) == sorted(surplus)
    assert {r.id for r in store.kept().collect()} == kept
    told = {r["kind"]: r["count"] for r in store.session.read.parquet(store.output).groupBy("kind").count().collect()}
    entries = store._entries().groupBy("h1", "h2").count()
    came_back = entries.where("count > 1").count()
    if horizon == "1 hour":  # most arrivals are late: identifiers expired, came back, and the lookup joined them
        assert told["expired"] > len(kept) and came_back > 10
    else:  # all live but those seen without a time only
        assert told.get("expired", 0) < 10 and told["surplus"] > 200
    # More files later: the same store goes on where it stopped.
    more = [(1000 + i, r[1], r[2], r[3], r[4], "x", "y") for i, r in enumerate(rows[:50])]
    stream(spark, store, more, path, 1)
    assert sorted(r.id for r in store.surplus().collect()) == sorted(brute(rows + more)[0])


def test_one_far_date_expires_nothing(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(minutes=i), f"u{i % 20}", "", "", "", "") for i in range(60)] + [(99, dt.datetime(2090, 1, 1), "far", "", "", "", "")]
    store = SeenStore(spark, f"file://{tmp_path}/store", "1 hour", stores=2, buckets=2)
    stream(spark, store, rows, str(tmp_path / "in"), 1)
    assert store.session.read.parquet(store.output).where("kind = 'expired'").count() == 0
    assert store.surplus().count() == 40


def test_replay_of_a_table(spark, tmp_path):
    rows = rows_of(300, 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("batch", F.floor(F.col("delivery_id") / 30))
    assert sorted(r.id for r in surplus_deliveries(df, "batch", horizon="3 days", files_per_batch=3).collect()) == sorted(brute(rows)[0])
    two = spark.createDataFrame([(1, None, "", "", "", "", ""), (2, None, None, None, None, "", ""), (2, None, None, None, None, "", "")], SCHEMA)
    assert [r.id for r in surplus_deliveries(two.withColumn("batch", F.lit(None).cast("int")), "batch").collect()] == [2]
    assert surplus_deliveries(df.limit(0), "batch").count() == 0


def test_entries_merge_as_a_dictionary_would():
    rng = random.Random(7)
    held, state, lost = np.empty(0, ENTRY), {}, []
    for _ in range(30):
        rows = [(rng.randrange(9), rng.randrange(2), rng.randrange(50), rng.randrange(500)) for _ in range(rng.randrange(12))]
        part = np.array([(*r, r[2]) for r in rows], dtype=ENTRY)
        held, surplus = merge_entries(held, part)
        lost += surplus["id"].tolist()
        for h1, h2, at, id in rows:
            state.setdefault((h1, h2), []).append((at, id))
    assert [(e["h1"], e["h2"], e["at"], e["id"], e["seen"]) for e in held] == [(*k, *min(v), max(x[0] for x in v)) for k, v in sorted(state.items())]
    assert set(lost) == {x[1] for v in state.values() for x in set(v) - {min(v)}}


def test_attach_and_newest(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), ("c", 3)], "k string, v int")
    state = spark.createDataFrame([("a", "A", 50), ("b", "B", 1), (None, "N", 1)], "k string, label string, n long")
    for hot in (10, 1000):
        got = attach(rows, state, ["k"], "n", 53, hot).groupBy("label").count().collect()
        assert {(r.label, r["count"]) for r in got} == {("A", 50), ("B", 1), ("N", 1)}
    t = spark.createDataFrame([(1, 5, "x", None), (1, 5, "y", 1), (1, None, "z", 2), (None, 1, "n", 3)], "k int, at int, a string, b int")
    assert {tuple(r) for r in newest(t, ["k"], "at", ["k", "at", "a", "b"]).collect()} == {(1, 5, "y", 1), (None, 1, "n", 3)}
