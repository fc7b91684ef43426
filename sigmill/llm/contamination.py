"""Held-out test passages inside a corpus, as a prefix-filtered set join.

A document and an item count as sharing a passage when they have a run of at least ``RUN_WORDS`` consecutive words in
common. Every item window of that size is a set of word shingles, all of which a document with the window must have;
so it is enough to join each window by its rarest shingle. Rarity is counted over the whole corpus. A joined pair is
bound by position (the window must lie inside the document) and then compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.runtime import bounded, cut, widened

RUN_WORDS = 13
SHINGLE_WORDS = 5
#: Bytes of text that one round of array operations takes; bounds a task's memory. A longer text is a slice of its own.
SLICE_BYTES = 1 << 21
#: Item shingles that are sent to the executors at once to filter the corpus; more items go in several blocks.
FILTER_SHINGLES = 2_000_000
#: Words of a stretch of text that is kept for verification; bounds what is carried along with each shingle in it.
STRETCH_WORDS = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _fold() -> np.ndarray:
    """Lower-case letter or digit that each byte stands for; 0 for the bytes that only separate words."""
    fold = np.zeros(256, np.uint8)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        fold[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        fold[c] = c + 32
    return fold


FOLD = _fold()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Words:
    """The words of texts that lie one after the other in ``data``, as positions, with a hash by shingle."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, size: int) -> None:
        self.folded = FOLD[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = self.folded != 0
        begin = inside[:-1].copy()
        begin[1:] &= ~inside[:-2]
        borders = bounds[(bounds > 0) & (bounds < len(data))]
        begin[borders] |= inside[borders]
        self.starts = np.flatnonzero(begin)
        stop = inside[:-1].copy()
        stop[:-1] &= ~inside[1:-1]
        stop[borders - 1] |= inside[borders - 1]
        self.ends = np.flatnonzero(stop) + 1
        #: number of words before each text
        self.first = np.searchsorted(self.starts, bounds)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.folded * _powers(_BASE, len(data)), dtype=np.uint64)])
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        words = _mixed((sums[self.ends] - sums[self.starts]) * _powers(inverse, len(data))[self.starts] + (self.ends - self.starts).astype(np.uint64))
        count = max(0, len(words) - size + 1)
        shingles = np.zeros(count, np.uint64)
        for k in range(size):
            shingles = shingles * _STEP + words[k : k + count]
        self.shingles = _mixed(shingles).view(np.int64)
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        #: whether the shingle at a word stays inside the word's text
        self.whole = text_of[:count] == text_of[size - 1 : size - 1 + count] if count else np.zeros(0, bool)
        self.text_of = text_of

    def text(self, low: int, high: int) -> str:
        """The words from ``low`` to before ``high``, with one blank between them."""
        return " ".join(self.folded[a:b].tobytes().decode() for a, b in zip(self.starts[low:high].tolist(), self.ends[low:high].tolist()))


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, bytes and bounds of slices of the texts."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        if offsets[high] > offsets[low]:
            yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def item_windows(items: DataFrame, run: int = RUN_WORDS, size: int = SHINGLE_WORDS) -> DataFrame:
    """Every window of ``run`` words of every item: ``item_id``, ``words`` and the ``shingles`` in it, in order."""
    picked = items.select(F.col("item_id").alias("key"), "text")
    kind = picked.schema["key"].dataType.simpleString()

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, shingles = [], [], []
            for first, data, bounds in _slices(batch.column("text")):
                w = Words(data, bounds, size)
                for n in range(len(bounds) - 1):
                    for low in range(int(w.first[n]), int(w.first[n + 1]) - run + 1):
                        keys.append(first + n)
                        words.append(w.text(low, low + run).split(" "))
                        shingles.append(w.shingles[low : low + run - size + 1])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), pa.array(words, pa.list_(pa.string())), pa.array(shingles, pa.list_(pa.int64()))], names=["key", "words", "shingles"])

    return picked.mapInArrow(cut_out, f"key {kind}, words array<string>, shingles array<bigint>").withColumnRenamed("key", "item_id")


def stretches(documents: DataFrame, wanted: np.ndarray, run: int = RUN_WORDS, size: int = SHINGLE_WORDS, most: int = STRETCH_WORDS) -> DataFrame:
    """Stretches of the documents around the ``wanted`` shingles, each wide enough for any run about a shingle in it.

    ``doc_id``, ``at`` (number of the first word in the text), ``words``, ``hits`` (the shingles that belong to the
    stretch) and ``places`` (their word numbers). Near shingles share a stretch of at most ``most`` words.
    """
    picked = widened(documents.select(F.col("doc_id").alias("key"), "text"))
    kind = picked.schema["key"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(np.sort(wanted))
    reach = run - size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        coarse = np.zeros(1 << 20, bool)
        coarse[listed & 0xFFFFF] = True
        for batch in batches:
            keys, at, words, hits, places = [], [], [], [], []
            for first, data, bounds in _slices(batch.column("text")):
                w = Words(data, bounds, size)
                hit = np.flatnonzero(w.whole & coarse[w.shingles & 0xFFFFF])
                place = np.minimum(np.searchsorted(listed, w.shingles[hit]), len(listed) - 1)
                hit = hit[listed[place] == w.shingles[hit]]
                owner = w.text_of[hit]
                low = np.maximum(hit - reach, w.first[owner])
                high = np.minimum(hit + run, w.first[owner + 1])
                a = 0
                while a < len(hit):
                    last = int(np.searchsorted(high, low[a] + most, "right"))  # high rises along the hits
                    b = max(a + 1, min(last, a + int(np.searchsorted(owner[a:last], owner[a], "right"))))
                    begin = w.first[owner[a]]
                    keys.append(first + int(owner[a]))
                    at.append(int(low[a] - begin))
                    words.append(w.text(int(low[a]), int(high[b - 1])).split(" "))
                    hits.append(w.shingles[hit[a:b]])
                    places.append((hit[a:b] - begin).astype(np.int32))
                    a = b
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(keys, pa.int64())), pa.array(at, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["key", "at", "words", "hits", "places"],
            )

    return picked.mapInArrow(scan, f"key {kind}, at int, words array<string>, hits array<bigint>, places array<int>").withColumnRenamed("key", "doc_id")


def _block(documents: DataFrame, windows: DataFrame, run: int, size: int) -> DataFrame:
    """(``doc_id``, ``item_id``) of the documents that hold one of the windows; the windows' shingles fit a broadcast."""
    wanted = np.array([r[0] for r in windows.select(F.explode("shingles")).distinct().collect()], np.int64)
    found = cut(stretches(documents, wanted, run, size))
    pair = F.explode(F.arrays_zip("hits", "places")).alias("hit")
    hits = found.select("doc_id", "at", "words", pair).select("doc_id", "at", "words", F.col("hit.hits").alias("shingle"), F.col("hit.places").alias("place"))
    rarity = found.select(F.explode("hits").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("found"))
    # the prefix of a window: of its shingles, all of which are necessary, the rarest in the corpus; if one doesn't
    # occur at all, no document has the window
    each = windows.select("window", F.posexplode("shingles").alias("offset", "shingle")).join(rarity, "shingle", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    rarest = each.groupBy("window").agg(F.min_by(F.struct("shingle", "offset", "found"), F.struct("found", "shingle", "offset")).alias("prefix")).where("prefix.found > 0")
    prefix = cut(rarest.join(windows.select("window", "item_id", F.col("words").alias("run")), "window").select("prefix.shingle", "prefix.offset", "run", "item_id"))
    if bounded(prefix):
        prefix = F.broadcast(prefix)
    low = F.col("place") - F.col("offset") - F.col("at")
    return (
        hits.join(prefix, "shingle")
        .where((low >= 0) & (low + run <= F.size("words")))  # the window lies inside the text
        .where(F.slice("words", low + 1, run) == F.col("run"))
        .select("doc_id", "item_id")
        .distinct()
    )


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN_WORDS, size: int = SHINGLE_WORDS, filter_shingles: int = FILTER_SHINGLES) -> DataFrame:
    """Distinct (``doc_id``, ``item_id``) of documents and items that share a run of at least ``run`` words.

    Words are runs of A-Z a-z 0-9 in lower case. NULL and empty texts, and texts of fewer than ``run`` words, share
    nothing; rows with a NULL key come out with it if their text matches; repeated rows and ties give one row; an empty
    table on either side gives an empty result. Only the key and text columns are read. Items with more shingles than
    ``filter_shingles`` go against the corpus in blocks.
    """
    windows = cut(item_windows(items, run, size).withColumn("window", F.monotonically_increasing_id()))
    total = windows.count() * (run - size + 1)
    blocks = max(1, -(-total // filter_shingles))
    out = None
    for n in range(blocks):
        own = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == n)
        found = _block(documents, own, run, size)
        out = found if out is None else out.unionByName(found)
    return out if blocks == 1 else out.distinct()
