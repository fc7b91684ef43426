"""Encoding of a text column with a byte-level BPE vocabulary.

Each task cuts its texts into words with array operations on the UTF-8 bytes and encodes every distinct word of a
slice once. A word's tokens are first proposed by greedy longest match; then every adjacent pair of proposed tokens is
tested for compatibility (would merging the bytes of the pair alone give this pair again?) for all words at once. A
sequence of self-encoding tokens whose adjacent pairs are all compatible is the BPE encoding, so only the words with a
failing pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.runtime import widened

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text that one round of array operations takes; bounds a task's memory. A longer text is a slice of its own.
SLICE_BYTES = 1 << 21

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_UNREACHED = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in set(printable)):
        alphabet[chr(256 + n)] = b
    return alphabet


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    chars = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    classes = np.zeros(0x110000, np.uint8)
    for code, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        classes[points[[m.start() for m in regex.finditer(pattern, chars)]]] = code
    return classes


class Vocabulary:
    """Lookup arrays of a byte-level BPE vocabulary; small (the file's size), so that it may be broadcast."""

    def __init__(self, path: str = VOCABULARY_FILE) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet = byte_alphabet()
        ids: dict[str, int] = model["vocab"]
        size = max(ids.values()) + 1
        self.size = size
        self.left = np.full(size, -1, np.int32)
        self.right = np.full(size, -1, np.int32)
        self.rank = np.full(size, -1, np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        first = np.array([ids[a] for a, _ in pairs], np.int64)
        second = np.array([ids[b] for _, b in pairs], np.int64)
        # a token may be reachable by several merges; its own last step is the earliest of them
        for n in range(len(pairs) - 1, -1, -1):
            self.left[merged[n]], self.right[merged[n]], self.rank[merged[n]] = first[n], second[n], n
        keys = first * size + second
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.pair_id = keys[order], order.astype(np.int32), merged[order]
        self.byte_id = np.zeros(256, np.int32)
        for char, byte in alphabet.items():
            self.byte_id[byte] = ids[char]
        self.classes = character_classes()
        usable = self._self_encoding()
        self._build_trie({bytes(alphabet[c] for c in text): n for text, n in ids.items() if usable[n]})

    def _self_encoding(self) -> np.ndarray:
        """Tokens whose bytes encode to the token itself; only these may be proposed."""
        usable = self.rank < 0
        composite = np.flatnonzero(~usable)
        composite = composite[np.argsort(self.rank[composite])]
        reached = self.compatible(self.left[composite], self.right[composite], self.rank[composite])
        for token, ok in zip(composite, reached):
            usable[token] = ok and usable[self.left[token]] and usable[self.right[token]]
        return usable

    def _build_trie(self, tokens: dict[bytes, int]) -> None:
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        nodes = 1
        for text, token in tokens.items():
            node = 0
            for byte in text:
                key = node * 256 + byte
                child = edges.get(key)
                if child is None:
                    child = edges[key] = nodes
                    nodes += 1
                node = child
            ends[node] = token
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        children = np.fromiter(edges.values(), np.int32, len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_child = keys[order], children[order]
        self.node_token = np.full(nodes, -1, np.int32)
        self.node_token[np.fromiter(ends.keys(), np.int64, len(ends))] = np.fromiter(ends.values(), np.int32, len(ends))
        # the first two bytes of a match are looked up directly
        self.one = np.zeros(256, np.int32)
        self.two = np.full(65536, -1, np.int32)
        root = self.edge_keys < 256
        self.one[self.edge_keys[root]] = self.edge_child[root]
        for byte in range(256):
            low, high = np.searchsorted(self.edge_keys, [int(self.one[byte]) * 256, int(self.one[byte]) * 256 + 256])
            self.two[byte * 256 + (self.edge_keys[low:high] & 255)] = self.edge_child[low:high]

    def compatible(self, x: np.ndarray, y: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of tokens ``x`` and ``y`` comes before the merges that made them.

        Goes back in time on all pairs together: undo the later of the two tokens' last merges, and look whether the
        parts that then meet at the border would have been merged first. Of equal merges the left one comes first.
        """
        ok = np.ones(len(x), bool)
        at = np.arange(len(x))
        x, y = x.astype(np.int64), y.astype(np.int64)
        limit = np.full(len(x), _UNREACHED, np.int64) if before is None else before.astype(np.int64)
        while len(at):
            keys = x * self.size + y
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            crossing = (self.pair_keys[place] == keys) & (self.pair_rank[place] < limit)
            ok[at[crossing]] = False
            rx, ry = self.rank[x], self.rank[y]
            stay = ~crossing & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[stay], x[stay], y[stay], rx[stay], ry[stay]
            undo_x = rx > ry
            limit = np.where(undo_x, rx, ry + 1).astype(np.int64)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def longest_matches(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token that starts at each byte and doesn't go past ``ends`` (of the byte's word); its length."""
        count = len(data)
        token, length = self.byte_id[data], np.ones(count, np.int32)
        at = np.flatnonzero(np.arange(count) + 1 < ends)
        node = self.two[data[at].astype(np.int32) * 256 + data[at + 1]]
        depth = 2
        alive = node >= 0
        at, node = at[alive], node[alive]
        while len(at):
            hit = self.node_token[node]
            found = hit >= 0
            token[at[found]], length[at[found]] = hit[found], depth
            room = at + depth < ends[at]
            at, node = at[room], node[room]
            keys = node.astype(np.int64) * 256 + data[at + depth]
            place = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            alive = self.edge_keys[place] == keys
            at, node = at[alive], self.edge_child[place[alive]]
            depth += 1
        return token, length

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one word after the other, and their number by word."""
        words = len(starts)
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        token, length = self.longest_matches(data, np.repeat(ends, ends - starts))
        word, at, steps = np.arange(words), starts.astype(np.int64), []
        while len(word):
            steps.append((word, token[at]))
            at = at + length[at]
            inside = at < ends[word]
            word, at = word[inside], at[inside]
        word = np.concatenate([w for w, _ in steps])
        ids = np.concatenate([t for _, t in steps])
        order = np.argsort(word, kind="stable")
        word, ids = word[order], ids[order]
        same = np.flatnonzero(word[1:] == word[:-1])
        failing = np.unique(word[same[~self.compatible(ids[same], ids[same + 1])]])
        counts = np.bincount(word, minlength=words)
        if not len(failing):
            return ids, counts
        offsets = np.concatenate([[0], np.cumsum(counts)])
        parts, last = [], 0
        for w in failing:
            exact = self.merge(data[starts[w] : ends[w]].tobytes())
            parts += [ids[last : offsets[w]], np.array(exact, np.int32)]
            counts[w], last = len(exact), offsets[w + 1]
        parts.append(ids[last:])
        return np.concatenate(parts), counts

    def merge(self, text: bytes) -> list[int]:
        """The BPE encoding by its definition: always the pair of lowest rank, the leftmost of equal ones."""
        pairs = self._pairs()
        ids = [int(self.byte_id[b]) for b in text]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(*hit, n) for n in range(len(ids) - 1) if (hit := pairs.get((ids[n], ids[n + 1])))]
        heap = [(rank, n, new, ids[n], ids[n + 1]) for rank, new, n in heap]
        heapq.heapify(heap)
        while heap:
            _, n, new, x, y = heapq.heappop(heap)
            m = after[n]
            if ids[n] != x or m < 0 or ids[m] != y:
                continue
            ids[n], ids[m] = new, -1
            after[n] = after[m]
            if after[n] >= 0:
                before[after[n]] = n
            for a, b in ((before[n], n), (n, after[n])):
                if a >= 0 and b >= 0 and (hit := pairs.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (hit[0], a, hit[1], ids[a], ids[b]))
        return [n for n in ids if n >= 0]

    def _pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        if "_pair_map" not in self.__dict__:
            x, y = np.divmod(self.pair_keys, self.size)
            self._pair_map = dict(zip(zip(x.tolist(), y.tolist()), zip(self.pair_rank.tolist(), self.pair_id.tolist())))
        return self._pair_map

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair_map"}


def word_starts(data: np.ndarray, text_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions at which the words begin of texts that lie one after the other in ``data`` (UTF-8).

    A word is a contraction ending, or a run of letters, of numbers or of other signs, each with one blank before it,
    or white space; of white space before a word the last character is left to the word if it is a blank, else alone.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[chars]
    kind = classes[lead]  # right for ASCII
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        at, top = chars[wide], lead[wide].astype(np.int32)
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        b, c, d = (padded[at + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        two, three = ((top & 0x1F) << 6) | b, ((top & 0x0F) << 12) | (b << 6) | c
        four = ((top & 0x07) << 18) | (b << 12) | (c << 6) | d
        kind[wide] = classes[np.where(top < 0xE0, two, np.where(top < 0xF0, three, four))]
    count = len(chars)
    opens = np.zeros(count + 1, bool)  # a text begins here; the end counts as one
    opens[np.searchsorted(chars, text_starts)] = True
    opens[0] = opens[count] = True
    begin = opens[:count].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # white space before a word
    runs = np.flatnonzero(begin)
    ends = np.append(runs[1:], count)
    before_word = (kind[runs] == SPACE) & ~opens[ends]
    last, then = ends[before_word] - 1, ends[before_word]
    begin[last] = True
    begin[then[lead[last] == 0x20]] = False
    # contractions: an apostrophe that begins a word, before s t m d, re ve ll
    quote = np.flatnonzero(begin & (lead == 0x27))
    if len(quote):
        tail = np.concatenate([lead, np.zeros(3, np.uint8)])
        shut = np.concatenate([opens, np.ones(3, bool)])
        one, two = tail[quote + 1], tail[quote + 2]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~shut[quote + 1]
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        double &= ~shut[quote + 1] & ~shut[quote + 2]
        for found, width in ((single, 2), (double & ~single, 3)):
            at = quote[found]
            begin[at + 1] = False
            rest = at + width
            begin[rest[rest < count]] = True
    return chars[begin]


def encode_texts(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts one after the other, and their number by text; none for NULL and for empty texts."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        part = np.ascontiguousarray(data[offsets[low] : offsets[high]])
        if len(part):
            bounds = offsets[low : high + 1] - offsets[low]
            words = word_starts(part, bounds[:-1][bounds[:-1] < bounds[1:]], vocabulary.classes)
            places = np.append(words, len(part)).astype(np.int32)
            every = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(places), pa.py_buffer(part)])
            coded = every.dictionary_encode()
            distinct, index = coded.dictionary, np.asarray(coded.indices)
            edges = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1].astype(np.int64)
            flat, sizes = vocabulary.encode_words(np.frombuffer(distinct.buffers()[2], np.uint8)[: edges[-1]], edges[:-1], edges[1:])
            starts = np.cumsum(sizes) - sizes
            lengths = sizes[index]
            total = np.cumsum(lengths)
            ids.append(flat[np.arange(total[-1]) + np.repeat(starts[index] - (total - lengths), lengths)])
            cumulated = np.concatenate([[0], total])
            border = np.searchsorted(words, bounds)
            counts[low:high] = cumulated[border[1:]] - cumulated[border[:-1]]
        low = high
    return np.concatenate(ids), counts


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY_FILE) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row of ``df``, texts taken as stored and without special tokens.

    NULL and empty texts get an empty list; a NULL key stays; repeated rows stay; an empty table gives an empty one.
    Other columns aren't read, whatever their names. Texts of any length are encoded whole. The vocabulary file is
    read on the driver and sent to the executors (its size doesn't depend on the data).
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            ids, counts = encode_texts(batch.column("text"), vocabulary)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "ids"])

    return widened(picked).mapInArrow(encode, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
