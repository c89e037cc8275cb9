"""Exactly one copy of messages that were delivered at least once, as a stream.

    deliveries -> combined per task -> keyed state store -> file sink

The engine's own state store (RocksDB) is keyed by buckets of identifiers: a
bucket's value holds, sorted by identifier, the delivery to keep so far and when
the identifier was seen last. A batch gets, merges and puts only the buckets it
touches, each as a whole and by vector operations; only changed buckets are
checkpointed. The engine commits state and output of a batch under one batch
number, and its file sink lists the files of committed batches only, so both
move together and a batch that is run again counts once.

An entry expires when the event-time watermark has passed its last sight by the
horizon; it then leaves the store and goes, as an ``expired`` row, to the
output. An identifier that comes back after that, or an arrival later than the
watermark, opens a new entry. Such entries of one identifier are brought
together by a lookup among the expired ones when the result is read, so no
delivery is lost or let through twice, however late it is.

Built-in operators drop late rows by the watermark mark on the event-time
column before any function sees them. The column that carries the mark is
therefore not passed on: it moves the watermark and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rankweave.operators.keyed import missing
from rankweave.session import checkpointed, remove, shared_dir

#: Stands for the time of a delivery that has none; later than any time.
UNDATED = 2**62
#: An entry of a bucket: identifier, the delivery to keep, the latest time seen in microseconds.
ENTRY = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("at", "<i8"), ("id", "<i8"), ("seen", "<i8")])
_STATE = "entries binary, timer long"
_OUT = "kind string, h1 long, h2 long, at long, id long"


def message_key(url: str, fallback: list[str]) -> list[Column]:
    """128 bits that tell a message: of the url, or where it is missing of the first two fallback columns."""
    none = missing(url)
    parts = [F.coalesce(F.col(c), F.lit("")) for c in fallback]
    key = (F.when(none, "f").otherwise("u"), F.when(none, parts[0]).otherwise(F.col(url)), F.when(none, parts[1]).otherwise(F.lit("")))
    return [F.xxhash64(*key).alias("h1"), F.xxhash64(F.lit("second"), *reversed(key)).alias("h2")]


def _combine(b: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """The first delivery of each message in a run of rows, as ``key`` rows of its bucket, and all others, which are surplus.

    Surplus rows need no entry; they go to the output by their own number, not
    by their key, so that a message delivered a million times is no hot key.
    ``clock`` moves the watermark: a tenth of the rows must be later for a time
    to count, so a few dates far off don't expire the store.
    """
    b = b.sort_values(["h1", "h2", "at", "id"], kind="stable").drop_duplicates(["h1", "h2", "at", "id"])
    surplus = b.duplicated(["h1", "h2"]).to_numpy()
    dated = b["at"].to_numpy()[b["at"].to_numpy() < UNDATED]
    clock = None if not len(dated) else int(np.quantile(dated, 0.9, method="lower") if len(dated) >= 10 else dated.min())
    return pd.DataFrame({
        "kind": np.where(surplus, "surplus", "key"), "bucket": np.where(surplus, b["id"], b["h1"]) % buckets,
        "h1": b["h1"], "h2": b["h2"], "at": b["at"], "id": b["id"],
        "clock": pd.Series([None if clock is None else pd.Timestamp(clock, unit="us")] * len(b), dtype="datetime64[us]", index=b.index),
    })


def merge_entries(held: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(entries, surplus)``: the first delivery of each identifier among both, sorted by identifier, and all others.

    A row that repeats an entry in full is neither.
    """
    both = np.concatenate([held, rows])
    both = both[np.lexsort((both["id"], both["at"], both["h2"], both["h1"]))]
    if not len(both):
        return both, both
    new = np.r_[True, (both["h1"][1:] != both["h1"][:-1]) | (both["h2"][1:] != both["h2"][:-1])]
    again = np.r_[False, (both["at"][1:] == both["at"][:-1]) & (both["id"][1:] == both["id"][:-1])] & ~new
    entries = both[new].copy()
    entries["seen"] = np.maximum.reduceat(both["seen"], np.flatnonzero(new))
    return entries, both[~new & ~again]


def _told(kind: str, rows: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, **{c: rows[c] for c in ("h1", "h2", "at", "id")}})


class Seen(StatefulProcessor):
    """One bucket of identifiers; at most one timer is set, for the entry that expires first."""

    def __init__(self, horizon_us: int):
        self.horizon = horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _STATE)

    def _held(self) -> tuple[np.ndarray, int]:
        got = self.bucket.get()
        return (np.empty(0, ENTRY), -1) if got is None else (np.frombuffer(bytes(got[0]), ENTRY), got[1])

    def _keep(self, entries: np.ndarray, had: bool, timer: int, timerValues) -> Iterator[pd.DataFrame]:
        """Expires what the watermark has passed and stores the rest."""
        over = entries["seen"] + self.horizon <= timerValues.getCurrentWatermarkInMs() * 1000
        if over.any():
            yield _told("expired", entries[over])
        rest = entries[~over]
        if len(rest):
            if timer < 0:
                timer = int(rest["seen"].min() + self.horizon) // 1000 + 1
                self.handle.registerTimer(timer)
            self.bucket.update((rest.tobytes(), timer))
        elif had:
            self.bucket.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == "surplus":
            for b in rows:
                yield b[["kind", "h1", "h2", "at", "id"]]
            return
        parts = []
        for b in rows:
            part = np.empty(len(b), ENTRY)
            for c in ("h1", "h2", "at", "id"):
                part[c] = b[c].to_numpy()
            part["seen"] = np.where(part["at"] < UNDATED, part["at"], -UNDATED)
            parts.append(part)
        held, timer = self._held()
        entries, surplus = merge_entries(held, np.concatenate(parts))
        if len(surplus):
            yield _told("surplus", surplus)
        yield from self._keep(entries, len(held) > 0, timer, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._held()
        yield from self._keep(held, len(held) > 0, -1, timerValues)

    def close(self) -> None:
        pass


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for blob in b["entries"]:
            x = np.frombuffer(bytes(blob), ENTRY)
            yield pd.DataFrame({c: x[c] for c in ("h1", "h2", "at", "id")})


class SeenStore:
    """Checkpoint, state and output of one stream under ``root``.

    ``horizon`` is how far behind the watermark an identifier stays live,
    ``stores`` the number of state partitions (the cores of the cluster unless
    given) and ``buckets`` the buckets of each; both are fixed once the stream
    has begun.
    """

    def __init__(self, spark: SparkSession, root: str, horizon: str = "7 days", stores: int | None = None, buckets: int = 8):
        self.root, self.horizon = root.rstrip("/"), horizon
        self.stores = stores or max(2, spark.sparkContext.defaultParallelism)
        self.buckets = self.stores * buckets
        self.session = spark.newSession()  # its settings are the stream's own
        for k, v in {
            "spark.sql.shuffle.partitions": self.stores,
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # what expires last expires with the next data
        }.items():
            self.session.conf.set(k, str(v))

    @property
    def output(self) -> str:
        return f"{self.root}/output"

    def horizon_us(self) -> int:
        return self.session.sql(f"select unix_micros(timestamp_micros(0) + interval {self.horizon}) as us").first()["us"]

    def _rows(self, kind: str) -> DataFrame:
        return self.session.read.schema(_OUT).parquet(self.output).where(F.col("kind") == kind)

    def _entries(self) -> DataFrame:
        """``(h1, h2, at, id)`` of every entry there has been: the live ones from the state, the expired from the output."""
        state = self.session.read.format("statestore").option("stateVarName", "bucket").load(f"{self.root}/checkpoint")
        live = state.select("value.entries").mapInPandas(_unpacked, "h1 long, h2 long, at long, id long")
        return live.unionByName(self._rows("expired").select("h1", "h2", "at", "id"))

    def surplus(self) -> DataFrame:
        """``id`` of every surplus delivery of the committed batches.

        Identifiers that had several entries are looked up among the expired:
        the earliest delivery stays, those that the other entries kept are
        surplus too. Few identifiers come back, so what is compared is found by
        a count over fixed-width keys first. Entries are written once, since
        reading them opens every state partition.
        """
        entries = checkpointed(self._entries())
        again = entries.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        several = entries.join(again, ["h1", "h2"], "left_semi")
        first = several.groupBy("h1", "h2").agg(F.min(F.struct("at", "id")).alias("first"))
        lost = several.join(first, ["h1", "h2"]).where(F.struct("at", "id") != F.col("first"))
        return self._rows("surplus").select("id").unionByName(lost.select("id")).distinct()

    def kept(self) -> DataFrame:
        """``(h1, h2, id)`` of the one delivery kept of each message."""
        return self._entries().groupBy("h1", "h2").agg(F.min(F.struct("at", "id")).alias("first")).select("h1", "h2", "first.id")


def dedupe_stream(stream: DataFrame, store: SeenStore, url: str, fallback: list[str], at: str, id: str) -> StreamingQuery:
    """Starts the query that feeds ``stream``, read with ``store.session``, through the store until what is available now is done.

    Of the deliveries of one message the one with the earliest ``at`` stays, on
    a tie the one with the smallest ``id``; every other is surplus, in whatever
    order and batch they come. If an earlier one comes later, the one kept so
    far becomes surplus then, so each message of n deliveries gives n - 1.

    Defined cases: null and empty ``url`` alike are missing; a missing fallback
    column compares as the empty string; a null ``at`` is later than any other,
    and an identifier seen without a time only is looked up, not kept live;
    rows that repeat in full, same ``id``, are one delivery; an empty stream
    gives no rows; other columns are ignored. A null ``id`` is an error.
    """
    buckets = store.buckets
    rows = stream.select(
        *message_key(url, fallback), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(UNDATED)).alias("at"), F.col(id).cast("long").alias("id")
    )
    combined = rows.mapInPandas(
        lambda batches: (_combine(b, buckets) for b in batches if len(b)), "kind string, bucket long, h1 long, h2 long, at long, id long, clock timestamp"
    )
    marked = combined.withWatermark("clock", "0 seconds").drop("clock")
    out = marked.groupBy("kind", "bucket").transformWithStateInPandas(Seen(store.horizon_us()), _OUT, "Append", "EventTime")
    return (
        out.writeStream.format("parquet").option("path", store.output)
        .option("checkpointLocation", f"{store.root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )


def land(df: DataFrame, order: list[str], files: int, path: str) -> None:
    """Writes deliveries as files in the order in which they arrived, about as many rows in each."""
    df.repartitionByRange(max(1, files), *order).write.parquet(path)


def surplus_deliveries(
    df: DataFrame, arrival: str, url: str = "url", fallback: tuple[str, str] = ("headline", "source"), at: str = "received_at",
    id: str = "delivery_id", horizon: str = "7 days", files_per_batch: int = 8, root: str | None = None,
) -> DataFrame:
    """Replays a table of deliveries as the stream they were; ``id`` of the surplus ones.

    ``arrival`` numbers the batches in which rows were delivered. The table is
    landed in that order, about one file to a delivered batch, and streamed
    through a fresh store ``files_per_batch`` files at a time. Landing and
    store are removed when the result is written, unless ``root`` names a
    folder to keep. Other columns are not read.
    """
    spark = df.sparkSession
    home = root or f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}"
    rows = df.select(*dict.fromkeys([arrival, url, *fallback, at, id]))
    files = rows.agg(F.countDistinct(arrival)).first()[0]
    land(rows, [arrival, id], files, f"{home}/arrived")
    store = SeenStore(spark, home, horizon)
    stream = store.session.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/arrived")
    dedupe_stream(stream, store, url, list(fallback), at, id).awaitTermination()
    out = store.surplus()
    if root is None:
        out = checkpointed(out)
        remove(spark, home)
    return out
