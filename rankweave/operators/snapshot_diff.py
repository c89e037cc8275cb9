"""What changed between consecutive full snapshots of a table.

All snapshots are brought into one key order by ranges of keys, whose edges are
quantiles of the keys there are, so a range holds about as many rows however the
keys lie. In that order rows are cut into content-defined chunks: a chunk begins
at every key whose hash falls on a boundary, in whichever snapshot it occurs, so
the same keys are in the same chunk of every snapshot. A chunk whose digests
agree in two consecutive snapshots is discarded; the rows of the others are
joined by key and classified. A chunk lies in one task with all its snapshots,
so neither digests nor rows move for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.keyed import newest


KINDS = np.array(["added", "removed", "changed"])


def _joined(old: np.ndarray, new: np.ndarray, key: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that differ between two runs of rows in order of key, and the number of their kind."""
    a, b = key[old], key[new]
    at = np.minimum(np.searchsorted(a, b), max(0, len(a) - 1))
    both = a[at] == b if len(a) else np.zeros(len(b), bool)
    gone = np.isin(a, b[both], assume_unique=True, invert=True)
    x, y = old[at[both]], new[both]
    changed = (d1[x] != d1[y]) | (d2[x] != d2[y])
    keys = np.concatenate([b[~both], a[gone], key[y[changed]]])
    return keys, np.repeat([0, 1, 2], [int((~both).sum()), int(gone.sum()), int(changed.sum())])


def chunk_changes(rows: dict[str, np.ndarray], chunk: np.ndarray, snaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(step, key, kind, joined)``: the changes within whole chunks, and how many pairs of chunks had to be joined.

    ``chunk`` numbers the chunks upwards. A chunk's digest is its count of rows
    and the wrapping sums of both prints of its rows.
    """
    snap, key, d1, d2 = (rows[c] for c in ("snap", "key", "d1", "d2"))
    order = np.lexsort((key, chunk, snap))
    s, c = snap[order], chunk[order]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
    last = np.r_[first[1:], len(order)]
    prints = [np.add.reduceat(d[order].view(np.uint64), first) for d in (d1, d2)]
    place = {x: i for i, x in enumerate(zip(np.searchsorted(snaps, s[first]).tolist(), c[first].tolist()))}
    size, none = last - first, np.empty(0, np.int64)
    steps, keys, kinds, joined = [], [], [], 0
    for (k, one), i in place.items():
        pairs = []
        if k > 0 and (j := place.get((k - 1, one))) is None:
            pairs.append((k, none, order[first[i] : last[i]]))
        if k + 1 < len(snaps):
            j = place.get((k + 1, one))
            if j is None:
                pairs.append((k + 1, order[first[i] : last[i]], none))
            elif size[i] != size[j] or prints[0][i] != prints[0][j] or prints[1][i] != prints[1][j]:
                pairs.append((k + 1, order[first[i] : last[i]], order[first[j] : last[j]]))
        for step, old, new in pairs:
            joined += 1
            found, kind = _joined(old, new, key, d1, d2)
            steps.append(np.full(len(found), snaps[step]))
            keys.append(found)
            kinds.append(kind)
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else none
    return cat(steps), cat(keys), cat(kinds), joined


_COLUMNS = ("snap", "key", "d1", "d2", "edge")


def changes_in_order(batches: Iterator[pa.RecordBatch], snaps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The changes of batches in key order; never more is held than a batch and the chunk that is still open."""
    held = {c: np.empty(0, np.int64) for c in _COLUMNS}

    def told(upto: int, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if upto:
            step, key, kind, _ = chunk_changes({c: v[:upto] for c, v in held.items()}, np.cumsum(starts[:upto]), snaps)
            if len(step):
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(key), pa.array(KINDS[kind])], names=["step", "key", "kind"])

    for batch in batches:
        for c in _COLUMNS:
            held[c] = np.concatenate([held[c], batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)])
        key = held["key"]
        starts = (held["edge"] != 0) & np.r_[True, key[1:] != key[:-1]]
        cut = int(np.flatnonzero(starts)[-1]) if starts.any() else 0
        yield from told(cut, starts)  # all but the chunk still open
        held = {c: v[cut:] for c, v in held.items()}
    key = held["key"]
    yield from told(len(key), (held["edge"] != 0) & np.r_[True, key[1:] != key[:-1]][: len(key)])


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    key: str,
    newest_by: str,
    compare: list[str],
    mean_keys: int = 64,
) -> DataFrame:
    """``(snapshot, key, change_kind)`` of each difference to the preceding snapshot.

    ``snapshot`` orders the snapshots and may have gaps; the first has no
    changes. Within a snapshot a key counts once, in the row with the greatest
    ``newest_by`` (ties: the greatest compared values, so every run agrees).
    ``change_kind`` is ``added`` (not in the preceding snapshot), ``removed``
    (no longer in this one) or ``changed`` (in both, and a compared column
    differs, null being a value of its own).

    Defined cases: rows without snapshot or key belong to no snapshot or
    record and are left out; repeated rows count once; other columns, whatever
    their names, are ignored; an empty table has no changes. ``key`` must be an
    integer column.

    Repeats are merged on the map side. Of what is left, one row per snapshot
    and key, five numbers move once, into ranges of keys; a key has one row per
    snapshot there, so no range is hot, and a chunk holds ``mean_keys`` keys on
    average however they are spaced. Nothing moves after that. Equal rows are
    told by two 64-bit prints. The driver reads the identifiers of the
    snapshots and nothing else.
    """
    rows = df.select(
        F.col(snapshot).cast("long").alias("snap"),
        F.col(key).cast("long").alias("key"),
        F.col(newest_by).alias("at"),
        F.struct(*(F.col(c) for c in compare)).alias("vals"),
    ).where(F.col("snap").isNotNull() & F.col("key").isNotNull())
    snaps = np.array(sorted(r["snap"] for r in rows.select("snap").distinct().collect()), dtype=np.int64)
    prints = newest(rows, ["snap", "key"], "at", ["snap", "key", "at", "vals"]).select(
        "snap", "key", *_prints(compare),
        F.when(F.pmod(F.xxhash64("key"), F.lit(mean_keys)) == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("edge"),
    )
    laid = prints.repartitionByRange("key").sortWithinPartitions("key", "snap")
    out = laid.mapInArrow(lambda batches: changes_in_order(batches, snaps), "step long, key long, kind string")
    return out.select(F.col("step").alias(snapshot), F.col("key").alias(key), F.col("kind").alias("change_kind"))


def _prints(compare: list[str]) -> list[Column]:
    """Two independent prints of a row; which columns are null counts, since a hash passes over nulls."""
    nulls = F.concat(F.lit("|"), *(F.when(F.col("vals")[c].isNull(), "1").otherwise("0") for c in compare))
    return [F.xxhash64("key", nulls, "vals").alias("d1"), F.xxhash64(F.lit(7), "vals", nulls, "key").alias("d2")]
