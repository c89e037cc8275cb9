"""Passages of held-out items inside a corpus, found with an FM-index per shard.

Each task cuts its stream of texts into shards of a bounded number of words and
builds for each an FM-index over the shard's own words: suffix array,
Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions. Test
phrases (every run of ``min_words`` words of every item) are searched backward
together, their occurrences located by walking to sampled positions, and
overlapping occurrences merged into spans.

Items come in passes of a bounded number of words, written once to the shared
folder and read by the tasks, so the driver never holds them. The index knows
nothing of the items: one scan of the corpus builds each index once and searches
all passes in it. Nothing is shuffled but the found spans.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.session import checkpointed, qualified, remove, shared_dir, spread

_WORD = re.compile(r"[^\W_]+")
# Characters that take no room, which a reader doesn't see inside a word.
_UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def words(text: str) -> list[str]:
    """The words of a text: letter case, punctuation and every kind of space set aside."""
    if not text.isascii():
        for c in _UNSEEN:
            if c in text:
                text = text.replace(c, "")
    return _WORD.findall(text.lower())


class WaveletMatrix:
    """Ranks of symbols in a sequence, all of many queries at a time."""

    def __init__(self, seq: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq.astype(np.int32, copy=True)
        for level in range(self.bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            ones = np.zeros(len(cur) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol, begin, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[end + 1] - ones[end]
            symbol = symbol * 2 + bit
            up = bit == 1
            begin = np.where(up, zeros + ones[begin], begin - ones[begin])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return symbol, end - begin

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        begin, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ((symbol >> (self.bits - 1 - k)) & 1) == 1
            begin = np.where(up, zeros + ones[begin], begin - ones[begin])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - begin


def suffix_array(seq: np.ndarray, size: int) -> np.ndarray:
    """Suffixes of ``seq`` in order; symbol 0 is a separator, each smaller than all else and ordered by place.

    The first sort takes as many symbols as fit 62 bits, each later one doubles
    them for the suffixes still tied, which end at the next separator.
    """
    n = len(seq)
    bits = max(1, int(size).bit_length())
    take = max(1, min(62 // bits, n or 1))
    ahead = np.concatenate([seq.astype(np.int64), np.zeros(take, np.int64)])
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for k in range(take):  # past a separator nothing counts
        sym = np.where(alive, ahead[k : k + n], 0)
        key = (key << bits) | sym
        alive &= sym > 0
    breaks = np.flatnonzero(seq == 0)
    inner = np.flatnonzero(seq > 0)
    if not len(inner):
        return breaks
    order = inner[np.argsort(key[inner], kind="stable")]
    sa = np.concatenate([breaks, order])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[breaks] = np.arange(len(breaks))
    sorted_keys = key[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    # A suffix that meets a separator within its key is told apart by that separator's place.
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) + len(breaks)
    rank[order] = group
    reach = take
    while True:
        size_of = np.bincount(rank[:n], minlength=n)
        tied = np.flatnonzero(size_of[rank[sa]] > 1)
        if not len(tied):
            return sa
        at = sa[tied]
        nxt = at + reach
        stop = breaks[np.minimum(np.searchsorted(breaks, at), len(breaks) - 1)] if len(breaks) else np.full(len(at), n)
        stop = np.where(stop < at, n, stop)
        # Beyond its separator a suffix has no more symbols: the separator decides.
        second = np.where(nxt >= stop, np.where(stop < n, rank[np.minimum(stop, n)], -1), rank[np.minimum(nxt, n)])
        sub = np.lexsort((second, rank[at]))
        at, second, first = at[sub], second[sub], rank[at][sub]
        sa[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        begin = np.ones(len(at), bool)
        begin[1:] = first[1:] != first[:-1]
        places = np.arange(len(at))
        offset = np.maximum.accumulate(np.where(new, places, 0)) - np.maximum.accumulate(np.where(begin, places, 0))
        rank[at] = first + offset
        reach *= 2


class FMIndex:
    """Full-text index of a sequence of symbols below ``size`` whose separators are 0."""

    def __init__(self, seq: np.ndarray, size: int, every: int = 16):
        n = len(seq)
        sa = suffix_array(seq, size)
        prev = np.concatenate([[0], seq[:-1]]) if n else seq
        self.n, self.size = n, size
        self.starts = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=size), out=self.starts[1:])
        self.bwt = WaveletMatrix(prev[sa], size)
        # A walk back never crosses a separator, so the place after each is a sample too.
        sampled = (sa % every == 0) | (prev[sa] == 0)
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = sa[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of ``phrases``: suffix ranges, empty where begin == end."""
        m, length = phrases.shape
        begin, end = self.starts[phrases[:, -1]].copy(), self.starts[phrases[:, -1] + 1].copy()
        live = np.flatnonzero(begin < end)
        for j in range(length - 2, -1, -1):
            if not len(live):
                break
            c = phrases[live, j]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([begin[live], end[live]]))
            begin[live], end[live] = self.starts[c] + both[: len(live)], self.starts[c] + both[len(live) :]
            live = live[begin[live] < end[live]]
        dead = begin >= end
        begin[dead] = end[dead] = 0
        return begin, end

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array places."""
        at, steps = at.astype(np.int64), np.zeros(len(at), np.int64)
        todo = np.flatnonzero(~self.sampled[at]) if len(at) else at
        while len(todo):
            symbol, rank = self.bwt.access(at[todo])
            at[todo] = self.starts[symbol] + rank
            steps[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.samples[self.sample_rank[at]] + steps


class Pass:
    """Some of the items: their different words, and every item as numbers of those, one after the other."""

    def __init__(self, vocabulary: list[str], seq: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        self.vocabulary, self.seq, self.ids, self.lengths = vocabulary, seq, ids, lengths
        self.item = np.repeat(np.arange(len(ids)), lengths)
        self.left = np.cumsum(lengths)[self.item] - np.arange(len(seq)) if len(seq) else seq

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Pass:
        number: defaultdict[str, int] = defaultdict(count().__next__)
        seqs = [np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in (words(t or "") for _, t in items)]
        return Pass(list(number), np.concatenate(seqs) if seqs else np.empty(0, np.int32), np.array([len(x) for x in seqs], np.int64), np.array([i for i, _ in items], np.int64))

    def phrases(self, numbers: dict[str, int], length: int, block: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(phrases, item numbers)`` in blocks of whole items: the runs of ``length`` words all of which ``numbers`` has, written in its numbers."""
        get = numbers.get
        seq = np.fromiter((get(w, 0) for w in self.vocabulary), np.int64, len(self.vocabulary))[self.seq]
        known = np.r_[0, np.cumsum(seq > 0)]
        at = np.flatnonzero(self.left >= length)
        at = at[known[at + length] - known[at] == length]
        for part in _whole(self.item[at], np.ones(len(at), np.int64), block):
            some = at[part]
            yield seq[some[:, None] + np.arange(length)], self.item[some]


def _whole(item: np.ndarray, weight: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows in order of item that never part an item and weigh little more than ``most``."""
    ends = np.flatnonzero(np.r_[item[1:] != item[:-1], True]) + 1 if len(item) else np.empty(0, np.int64)
    total, begin = np.cumsum(weight), 0
    while begin < len(item):
        reach = np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right")
        end = int(ends[min(np.searchsorted(ends, max(int(reach), begin + 1)), len(ends) - 1)])
        yield slice(begin, end)
        begin = end


def _located(index: FMIndex, phrases: np.ndarray, of: np.ndarray, block: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, items)`` of every occurrence of the phrases, in blocks of whole items."""
    begin, end = index.search(phrases)
    hit = np.flatnonzero(begin < end)
    hit = hit[np.unique(np.stack([of[hit], begin[hit]]), axis=1, return_index=True)[1]] if len(hit) else hit  # a phrase twice in an item
    times = end[hit] - begin[hit]
    for part in _whole(of[hit], times, block):
        some, n = hit[part], times[part]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[some], n)
        yield index.locate(at), np.repeat(of[some], n)


def _merged(doc: np.ndarray, item: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of an item in a document joined where they touch or overlap."""
    order = np.lexsort((first, item, doc))
    doc, item, first = doc[order], item[order], first[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (first[1:] > first[:-1] + length)] if len(doc) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    return doc[begin], item[begin], first[begin], np.r_[first[begin[1:] - 1], first[-1:]] + length


def scan_shards(docs: Iterator[tuple[object, str]], passes: Callable[[], Iterable[Pass]], length: int, shard_words: int) -> Iterator[pd.DataFrame]:
    """Frames of ``doc_key, item_key, first_word, end_word``; spans of one item in one text are merged.

    An index is searched for all passes before the next is built. What is held
    is one shard, one pass and the occurrences of a block of its items.
    """
    number: defaultdict[str, int] = defaultdict(count(1).__next__)
    parts: list[np.ndarray] = []
    begins: list[tuple[int, object, int]] = []  # place in the shard, document, word of the document
    filled = 0

    def flush() -> Iterator[pd.DataFrame]:
        nonlocal filled
        if filled:
            index = FMIndex(np.concatenate(parts), len(number) + 1)
            place = np.array([b[0] for b in begins])
            skip = np.array([b[2] for b in begins])
            for one in passes():
                for phrases, of in one.phrases(number, length):
                    for at, item in _located(index, phrases, of):
                        piece = np.searchsorted(place, at, side="right") - 1
                        piece, item, first, stop = _merged(piece, item, at - place[piece] + skip[piece], length)
                        yield pd.DataFrame({
                            "doc_key": pd.array([begins[k][1] for k in piece.tolist()], dtype=object), "item_key": one.ids[item],
                            "first_word": first.astype(np.int64), "end_word": stop.astype(np.int64),
                        })
        parts.clear()
        begins.clear()
        number.clear()
        number.default_factory = count(1).__next__
        filled = 0

    for doc, text in docs:
        found = words(text)
        if len(found) < length:
            continue
        step = shard_words - length + 1
        for k in range(0, max(1, len(found) - length + 1), step):  # a text longer than a shard is cut with overlap
            piece = found[k : k + shard_words]
            begins.append((filled, doc, k))
            parts += [np.fromiter(map(number.__getitem__, piece), np.int32, len(piece)), np.zeros(1, np.int32)]
            filled += len(piece) + 1
            if filled >= shard_words:
                yield from flush()
    yield from flush()


def _file_system(path: str):
    """The file system of a qualified path, for tasks, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


_last: dict[tuple[str, int], Pass] = {}


def read_passes(path: str) -> Iterator[Pass]:
    """The passes in a folder, one at a time; the last one read is kept, so a single pass is read once a worker."""
    system, at = _file_system(path)
    for info in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda x: x.path):
        if not info.path.endswith(".parquet"):
            continue
        groups = (path, info.path)
        with system.open_input_file(info.path) as f:
            table = pq.ParquetFile(f)
            for k in range(table.num_row_groups):
                if (groups, k) not in _last:
                    row = table.read_row_group(k).to_pylist()[0]
                    _last.clear()
                    _last[groups, k] = Pass(row["vocabulary"], np.frombuffer(row["seq"], np.int32), np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["ids"], np.int64))
                yield _last[groups, k]


def write_passes(items: DataFrame, path: str, pass_words: int) -> int:
    """Writes ``(id, t)`` rows as passes of about ``pass_words`` words, a file each; the number of passes."""
    n_words = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    passes = max(1, -(-n_words // pass_words))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        one = Pass.of(sorted(zip(group["id"].tolist(), group["t"])))
        return pd.DataFrame({"vocabulary": [one.vocabulary], "seq": [one.seq.tobytes()], "lengths": [one.lengths.tobytes()], "ids": [one.ids.tobytes()]})

    rows = items.withColumn("pass", F.pmod(F.xxhash64("id", "t"), F.lit(passes)))
    built = rows.groupBy("pass").applyInPandas(build, "vocabulary array<string>, seq binary, lengths binary, ids binary")
    built.write.option("maxRecordsPerFile", 1).parquet(path)
    return passes


#: Items are read in passes of so many words; a pass is what a task holds of them at a time.
PASS_WORDS = 2_000_000


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc: str, text: str, item: str, item_text: str, min_words: int = 12,
    shard_words: int = 500_000, pass_words: int = PASS_WORDS,
) -> DataFrame:
    """``(doc_id, item_id, first_word, end_word)``: each span of a text that an item's words fill, ``min_words`` at least.

    Words count from 0; ``end_word`` is the one after the last. A text longer
    than a shard may give touching spans. Passes of items lie in the shared
    folder until the spans, which are few, are written there; then they are
    removed. Executors reach that folder through Arrow's file systems.

    Defined cases: null and empty texts hold nothing; items of fewer than
    ``min_words`` words reveal nothing; texts and items that repeat give a row
    per repeat of the text and one per item; an empty corpus or no items give
    no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("t")).where("id is not null and t is not null").distinct()
    folder = qualified(spark, f"{shared_dir(spark)}/passes-{uuid.uuid4().hex}")
    write_passes(asked, folder, pass_words)
    rows = docs.select(F.col(doc).cast("long").cast("string").alias("doc_key"), F.col(text).alias("t")).where("t is not null and t != ''")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = ((k, t) for b in batches for k, t in zip(b["doc_key"], b["t"]))
        yield from scan_shards(texts, lambda: read_passes(folder), min_words, shard_words)

    found = spread(rows, "doc_key").mapInPandas(scan, "doc_key string, item_key long, first_word long, end_word long")
    found = checkpointed(found.select(F.col("doc_key").cast("long").alias("doc_id"), F.col("item_key").alias("item_id"), "first_word", "end_word"))
    remove(spark, folder)
    return found
