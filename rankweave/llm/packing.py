"""Texts packed into containers of a fixed number of tokens with as little room unused as possible.

Texts are measured where they are read; only identifiers and sizes move.
Packing works on shards of a bounded number of texts, largest first, into the
tightest container that fits and is compatible. A container carries two
bitmaps, of the sources and of the clusters of copies it already holds; the
search goes on from the tightest container to the next larger residual until
one holds neither a copy of the text nor as many texts of its source as it may.
Where no open container is compatible a new one is opened: the constraint is
never given up for room.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.leakage import words
from rankweave.session import checkpointed, spread

# Fixed value: the public pattern by which the byte-level tokenizers cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A vocabulary file is sent to every task; larger ones are refused.
MAX_VOCABULARY_BYTES = 32 << 20


def read_vocabulary(path: str) -> bytes:
    """The file as the driver has it, its size checked."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, vocabulary: bytes | str = VOCABULARY) -> int:
    """Tokens of a text, special strings read as ordinary text; ``vocabulary`` is the file or its path."""
    if not text:
        return 0
    return len(_encoding(vocabulary if isinstance(vocabulary, bytes) else read_vocabulary(vocabulary)).encode_ordinary(text))


def fingerprint(text: str) -> int:
    """The same for copies that differ in case, punctuation or space only."""
    return xxhash.xxh3_64_intdigest(" ".join(words(text)).encode("utf-8", "surrogatepass")) - 2**63


class ResidualBins:
    """Open containers by the room left in them.

    ``filled`` is one integer whose bit r tells that some container has r
    tokens left, so the next larger residual is found by a shift.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[int]] = defaultdict(list)
        self.filled = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.room: list[int] = []
        self.count: list[int] = []

    def _successor(self, room: int) -> int:
        rest = self.filled >> room
        return -1 if not rest else room + (rest & -rest).bit_length() - 1

    def _tightest(self, size: int, source: int, cluster: int) -> int:
        """The fullest container that fits and holds none of the bits, taken out of the order; -1 if there is none."""
        sources, clusters = self.sources, self.clusters
        r = self._successor(size)
        while r >= 0:
            at = self.by_room[r]
            for k, b in enumerate(at):
                if not (sources[b] & source or clusters[b] & cluster):
                    at[k] = at[-1]  # the order within a residual means nothing
                    at.pop()
                    if not at:
                        self.filled &= ~(1 << r)
                    return b
            r = self._successor(r + 1)
        return -1

    def put(self, size: int, source: tuple[int, ...], cluster: int) -> tuple[int, int, int]:
        """``(container, place, start)`` for a text.

        ``cluster`` is the bit of its copies. ``source`` are the bits of its
        source's first, second ... text in one container: as many as may share
        one. The last bit is the one to avoid.
        """
        b = self._tightest(size, source[-1] if source else 0, cluster)
        if b < 0:
            b = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            self.count.append(0)
        held = self.sources[b]
        return self._place(b, size, next((x for x in source if not held & x), 0), cluster)

    def _place(self, b: int, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        start = self.capacity - self.room[b]
        self.room[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.count[b] += 1
        self.by_room[self.room[b]].append(b)
        self.filled |= 1 << self.room[b]
        return b, self.count[b], start


def _bits(labels: np.ndarray, share: int) -> list[tuple[int, ...]]:
    """For each text the bits of its label: one, or where a label has more than ``share`` members one for each ``share`` of them begun.

    The label 0 and labels of a single member conflict with nothing.
    """
    _, at, members = np.unique(labels, return_inverse=True, return_counts=True)
    zero = labels[np.unique(at, return_index=True)[1]] == 0 if len(labels) else np.zeros(0, bool)
    width = np.where((members > 1) & ~zero, -(-members // max(1, share)), 0)
    first = np.cumsum(width) - width
    bits = [tuple(1 << (int(f) + i) for i in range(int(w))) for f, w in zip(first, width)]
    return [bits[k] for k in at]


def _members(labels: np.ndarray) -> np.ndarray:
    """How many texts share each text's label; 0 for the label 0."""
    if not len(labels):
        return labels
    _, at, members = np.unique(labels, return_inverse=True, return_counts=True)
    return np.where(labels == 0, 0, members[at])


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, crowded: int = 16) -> np.ndarray:
    """Container, place and start of each text. Label 0 conflicts with nothing.

    Copies of one cluster never meet. Texts of one source never meet either if
    there are no more of them than containers are needed at least; of a larger
    source, which no packing could keep apart, each container takes as even a
    share as the numbers allow.

    Texts go in falling order of size, but those of sources and clusters that
    need more than a ``crowded``-th of the containers go first: once they stand
    apart, all other texts find room between them.
    """
    bins = ResidualBins(capacity)
    needed = max(1, -(-int(sizes.sum()) // capacity))
    press = np.maximum(_members(sources), _members(clusters))
    order = np.lexsort((-sizes, press * crowded <= needed))
    one = [x[0] if x else 0 for x in _bits(clusters, max(1, len(clusters)))]
    many = _bits(sources, needed)
    placed = np.zeros((len(sizes), 3), dtype=np.int64)
    for k in order.tolist():
        placed[k] = bins.put(int(sizes[k]), many[k], one[k])
    return placed


def pack_texts(
    df: DataFrame, id: str, text: str, source: str, capacity: int = 2048, shard_texts: int = 20_000, vocabulary: str = VOCABULARY,
    labels: bool = False,
) -> DataFrame:
    """``(id, piece, token_start, n_tokens, container, place, start)`` of every text or piece of text.

    A text longer than ``capacity`` fills containers of its own and its rest is
    packed like any text; no other is divided. ``piece`` and ``place`` count
    from 1; ``token_start`` is where the piece begins in its text, ``start``
    where it begins in its container. Containers are numbered apart by shard.
    With ``labels`` the prints of source and cluster are given as well.

    Defined cases: a null text is packed as an empty one, of 0 tokens; rows
    with the same id are texts of their own; a missing source conflicts with
    nothing; texts that are equal but for case, punctuation and space are one
    cluster of copies and never share a container, nor do texts of one source
    where the shard has room for that (see ``pack``); pieces that fill a
    container are alone in it; other columns are ignored; an empty table packs
    nothing.

    ``vocabulary`` is a file the driver has; it is sent to the tasks.

    Shards are a hash of the id: their number follows the number of rows, so
    each task sorts and packs ``shard_texts`` rows of eight numbers, whatever
    the text's length, and at most a few containers per shard stay part empty.
    """
    shards = max(1, -(-df.count() // shard_texts))
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = df.select(F.col(id).cast("long").cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(source), F.lit("")).alias("source"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [count_tokens(t, sent.value) for t in b["text"]]
            src = [xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - 2**63 if s else 0 for s in b["source"]]
            yield pd.DataFrame({"id": b["id"], "n": n, "src": src, "clu": [fingerprint(t) if t else 0 for t in b["text"]]})

    sized = spread(rows, "id").mapInPandas(measure, "id string, n long, src long, clu long")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("id", "clu"), F.lit(shards)))
    ordered = sized.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", F.expr(f"n % {capacity}").desc(), "clu", F.col("id").cast("long"), "n")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def close() -> pd.DataFrame:
            d = pd.concat(held, ignore_index=True)
            held.clear()
            n, src, clu = (d[c].to_numpy(np.int64) for c in ("n", "src", "clu"))
            whole, rest = n // capacity, n % capacity
            packed = (rest > 0) | (n == 0)
            at = pack(rest[packed], src[packed], clu[packed], capacity)
            base = int(d["shard"].iloc[0]) << 32
            parts = [pd.DataFrame({
                "id": d["id"][packed], "piece": whole[packed] + 1, "token_start": whole[packed] * capacity, "n_tokens": rest[packed],
                "container": base + at[:, 0], "place": at[:, 1], "start": at[:, 2], "source": src[packed], "cluster": clu[packed],
            })]
            if whole.any():
                k = np.repeat(np.arange(len(d)), whole)
                nth = np.arange(len(k)) - np.repeat(np.cumsum(whole) - whole, whole)
                parts.append(pd.DataFrame({
                    "id": d["id"].to_numpy()[k], "piece": nth + 1, "token_start": nth * capacity, "n_tokens": capacity,
                    "container": base + (at[:, 0].max() + 1 if len(at) else 0) + np.arange(len(k)), "place": 1, "start": 0, "source": src[k], "cluster": clu[k],
                }))
            return pd.concat(parts, ignore_index=True)

        shard = None
        for b in batches:
            for s, part in b.groupby("shard", sort=True):
                if shard is not None and s != shard and held:
                    yield close()
                shard = s
                held.append(part)
        if held:
            yield close()

    out = ordered.mapInPandas(fill, "id string, piece long, token_start long, n_tokens long, container long, place long, start long, source long, cluster long")
    if not labels:
        out = out.drop("source", "cluster")
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id)


def token_counts(df: DataFrame, id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, n_tokens)`` of every text, measured where it is read; a null text has none."""
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count_tokens(t, sent.value) if t else 0).astype("int64")

    return spread(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "id").select(F.col("id").alias(id), count("text").alias("n_tokens"))


def ledger(packed: DataFrame, measured: DataFrame, id: str, capacity: int = 2048) -> DataFrame:
    """``(what, n)``: texts placed, and how often the rules of packing are broken; all but ``texts`` should be 0.

    ``packed`` is ``pack_texts`` with labels, ``measured`` the tokens of each
    id. Only sources with no more texts than containers are needed can stand
    apart everywhere; only those count.
    """
    packed = checkpointed(packed)
    one = lambda what, n: n.select(F.lit(what).alias("what"), F.col("n").cast("long").alias("n"))
    twice = lambda label: packed.where(F.col(label) != 0).groupBy("container", label).count().where("count > 1")
    needed = packed.select((F.sum("n_tokens") / capacity).alias("n")).scalar()
    apart = packed.where("source != 0").groupBy("source").agg(F.count("*").alias("k")).where(F.col("k") <= needed).select("source")
    placed = packed.groupBy(id).agg(F.sum("n_tokens").alias("n_placed"))
    wanted = measured.groupBy(id).agg(F.sum("n_tokens").alias("n_wanted"))
    both = wanted.join(placed, wanted[id].eqNullSafe(placed[id]), "full_outer")
    parts = [
        one("texts", placed.agg(F.count("*").alias("n"))),
        one("overfull", packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).where(F.col("t") > capacity).agg(F.count("*").alias("n"))),
        one("copies together", twice("cluster").agg(F.count("*").alias("n"))),
        one("sources together", twice("source").join(apart, "source", "left_semi").agg(F.count("*").alias("n"))),
        one("tokens lost", both.where(~F.col("n_wanted").eqNullSafe(F.col("n_placed"))).agg(F.count("*").alias("n"))),
    ]
    return reduce(DataFrame.unionByName, parts)
