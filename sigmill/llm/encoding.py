"""Text that was decoded with the wrong character encoding: find it and restore it.

A multinomial classifier over hashed byte bigrams, trained on clean list entries garbled by every known chain, tells
which chain a value went through. The chain is then undone step by step, and only strictly decodable sequences are
taken back; a value of which nothing decodes was not garbled.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.runtime import cut

#: Buckets that the byte bigrams are hashed to.
BUCKETS = 4096
#: Entries of the reference lists that the classifier is trained on at most; the lists have a fixed size.
TRAINING_ENTRIES = 20_000
SUBSTITUTE = "�"
READING = "field_name string, stored_text string, chain string, restored string, rank int, likely boolean"

#: Chains, by name: the code pages in which UTF-8 bytes were read, first step first. ``latin1`` leaves control characters.
CHAINS: dict[str, tuple[str, ...]] = {
    "cp1252": ("cp1252",),
    "latin1": ("latin1",),
    "cp1250": ("cp1250",),
    "cp1251": ("cp1251",),
    "cp1254": ("cp1254",),
    "cp1257": ("cp1257",),
    "iso8859_2": ("iso8859_2",),
    "iso8859_9": ("iso8859_9",),
    "iso8859_15": ("iso8859_15",),
    "mac_roman": ("mac_roman",),
    "cp437": ("cp437",),
    "cp850": ("cp850",),
    "cp852": ("cp852",),
    "koi8_r": ("koi8_r",),
    "cp1252 twice": ("cp1252", "cp1252"),
    "latin1 twice": ("latin1", "latin1"),
    "latin1, cp1252": ("latin1", "cp1252"),
    "cp1252, latin1": ("cp1252", "latin1"),
}


def _to_byte(page: str) -> dict[str, int]:
    """Byte of each character in a code page; the bytes that a Windows page leaves open are control characters."""
    table = {}
    for byte in range(128, 256):
        try:
            char = bytes([byte]).decode(page)
        except UnicodeDecodeError:
            char = chr(byte)
        table.setdefault(char, byte)
    return table


TO_BYTE = {page: _to_byte(page) for chain in CHAINS.values() for page in chain}
TO_CHAR = {page: {b: c for c, b in table.items()} for page, table in TO_BYTE.items()}


def garble(text: str, chain: tuple[str, ...]) -> str:
    """``text`` as it looks after its UTF-8 bytes were read in the chain's code pages one after the other."""
    for page in chain:
        chars = TO_CHAR[page]
        text = "".join(chars.get(b, chr(b)) for b in text.encode())
    return text


def sequences(text: str, page: str) -> list[tuple[str, str | None]]:
    """``text`` in parts, each with what it decodes to: a well-formed UTF-8 character beyond ASCII, or None.

    A part decodes only if all its characters are bytes of the page and together strictly one such character; every
    other character is a part that stays, so a value that is garbled in part is restored in part.
    """
    table = TO_BYTE[page]
    parts: list[tuple[str, str | None]] = []
    at = 0
    while at < len(text):
        lead = table.get(text[at], 0)
        width = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        raw, decoded = text[at : at + max(1, width)], None
        if width and len(raw) == width:
            try:
                decoded = bytes([lead, *(table.get(c, 0) for c in raw[1:])]).decode()
            except UnicodeDecodeError:
                pass
        raw = raw if decoded else text[at]
        parts.append((raw, decoded))
        at += len(raw)
    return parts


def undo(text: str, page: str) -> tuple[str, int]:
    """``text`` with every decodable sequence taken back, and their number."""
    parts = sequences(text, page)
    return "".join(decoded or raw for raw, decoded in parts), sum(decoded is not None for _, decoded in parts)


def restore(text: str, chain: tuple[str, ...]) -> tuple[str, bool]:
    """``text`` with the chain undone, and whether each of its steps took back at least one sequence."""
    for page in reversed(chain):
        text, found = undo(text, page)
        if not found:
            return text, False
    return text, True


def fits(text: str, chain: tuple[str, ...], entry: str) -> bool:
    """Whether ``entry`` (upper case) is ``text`` with the chain undone in some of its sequences and the others left.

    Correct letters may look like a garbled one. The text is followed along the entry, each sequence as it is or
    decoded, so that any number of sequences takes one pass; the earlier steps of the chain are undone in full.
    """
    for page in reversed(chain[1:]):
        text = undo(text, page)[0]
    at = {0}
    for raw, decoded in sequences(text, chain[0]):
        forms = {raw.upper(), *([decoded.upper()] if decoded else [])}
        at = {p + len(form) for p in at for form in forms if entry.startswith(form, p)}
        if not at:
            return False
    return len(entry) in at


def bigram_buckets(text: str) -> np.ndarray:
    """Hashed byte bigrams of a text in UTF-8 that touch a byte beyond ASCII; the others are alike in all chains."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    if len(data) < 2:
        return np.zeros(0, np.int64)
    first, second = data[:-1], data[1:]
    touch = (first | second) >= 128
    return ((first * 256 + second)[touch] * 40503 >> 3) % BUCKETS


def synthetic(entries: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Training rows (chain, text): every accented entry as it is, in lower and mixed case, and garbled by each chain."""
    for entry in entries:
        if entry is None or entry.isascii():
            continue
        mixed = "".join(c.lower() if ord(c) > 127 else c for c in entry)
        for form in {entry, entry.lower(), entry.title(), mixed, unicodedata.normalize("NFD", entry)}:
            yield "clean", form
            for name, chain in CHAINS.items():
                bad = garble(form, chain)
                if bad != form:
                    yield name, bad


def train(entries: DataFrame, column: str, limit: int = TRAINING_ENTRIES) -> tuple[list[str], np.ndarray]:
    """Names of the classes and log probabilities (class x bucket, last column: the class itself).

    The counts are made on the executors; the model that comes back has a fixed size (classes x buckets).
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, int(b), 1) for name, text in synthetic(iter(batch["entry"])) for b in (*bigram_buckets(text), BUCKETS)]
            yield pd.DataFrame(rows, columns=["chain", "bucket", "n"]).groupby(["chain", "bucket"], as_index=False).sum()

    sample = entries.select(F.col(column).alias("entry")).where(F.col("entry").rlike(r"[^\x00-\x7F]")).distinct().orderBy("entry").limit(limit)
    rows = sample.mapInPandas(count, "chain string, bucket int, n long").groupBy("chain", "bucket").agg(F.sum("n").alias("n")).collect()
    classes = ["clean", *CHAINS]
    counts = np.full((len(classes), BUCKETS + 1), 0.05)
    for r in rows:
        counts[classes.index(r["chain"]), r["bucket"]] += r["n"]
    model = np.log(counts)
    model[:, :BUCKETS] -= np.log(counts[:, :BUCKETS].sum(1, keepdims=True))
    model[:, BUCKETS] -= math.log(counts[:, BUCKETS].sum())
    return classes, model


def diagnose(text: str, classes: list[str], model: np.ndarray) -> list[tuple[str, str, int, bool]]:
    """Readings (chain, restored text, rank, likelier than clean) of a value; none for a value in order.

    The chains come in the classifier's order; a chain is a reading only if each of its steps can be strictly undone
    on some part of the value and what comes out is plausible. A value that holds the substitute character has lost
    characters, which no chain brings back: its one reading is ``lost``.
    """
    if SUBSTITUTE in text:
        return [("lost", text, 0, True)]
    if text.isascii():
        return []
    composed = unicodedata.normalize("NFC", text)
    scores = model[:, BUCKETS] + model[:, bigram_buckets(composed)].sum(1)
    clean, readings = scores[classes.index("clean")], {}
    for rank, n in enumerate(np.argsort(-scores, kind="stable").tolist()):
        if classes[n] == "clean":
            continue
        fixed, ok = restore(composed, CHAINS[classes[n]])
        if ok and plausible(fixed) and fixed not in readings:
            readings[fixed] = (classes[n], fixed, rank, bool(scores[n] > clean))
    return list(readings.values())


def plausible(text: str) -> bool:
    """Whether a restored text has only letters, marks, digits, blanks and common signs."""
    return all(ord(c) < 128 or unicodedata.category(c)[0] in "LMN" or unicodedata.category(c) in ("Pd", "Pi", "Pf", "Sm", "So", "Sc", "Po", "Zs", "Sk") for c in text) and not any(
        0x2500 <= ord(c) <= 0x25FF or 0x80 <= ord(c) <= 0x9F for c in text
    )


def garbled_values(values: DataFrame, classes: list[str], model: np.ndarray) -> DataFrame:
    """The readings (see ``diagnose``) of the distinct (field_name, stored_text): a few rows for each chain.

    NULL and empty values are in order; very long ones are treated whole; an empty table gives an empty result.
    """
    shared = values.sparkSession.sparkContext.broadcast((classes, model))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, table = shared.value
        for batch in batches:
            rows = []
            for field, text in zip(batch["field_name"], batch["stored_text"]):
                rows += [(field, text, *reading) for reading in diagnose(text, names, table)]
            yield pd.DataFrame(rows, columns=["field_name", "stored_text", "chain", "restored", "rank", "likely"])

    beyond = values.where(F.col("stored_text").rlike(r"[^\x00-\x7F]"))
    return beyond.mapInPandas(find, READING)


def partly_garbled(values: DataFrame, readings: DataFrame, entries: DataFrame, classes: list[str], model: np.ndarray) -> DataFrame:
    """Readings of values that are a listed text with only some of their decodable sequences garbled (see ``fits``).

    ``values`` has ``field_name`` and ``stored_text``, ``readings`` their full readings, ``entries`` ``field_name`` and
    ``whole``. Values and entries are joined by their letters within ASCII, which no reading changes, and by the first
    and last letter, stored or restored; the joined pairs are then followed letter by letter.
    """
    shared = values.sparkSession.sparkContext.broadcast((classes, model))
    ascii_part = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]+", "")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, table = shared.value
        for batch in batches:
            rows = []
            for field, text, whole in zip(batch["field_name"], batch["stored_text"], batch["whole"]):
                composed = unicodedata.normalize("NFC", text)
                for chain, _, rank, _ in diagnose(text, names, table):
                    if chain != "lost" and fits(composed, CHAINS[chain], whole):
                        rows.append((field, text, chain, whole, rank + len(names), False))
            yield pd.DataFrame(rows, columns=["field_name", "stored_text", "chain", "restored", "rank", "likely"])

    forms = values.select("field_name", "stored_text", F.upper("stored_text").alias("form")).unionByName(readings.where("chain <> 'lost'").select("field_name", "stored_text", F.upper("restored").alias("form")))
    ends = lambda c: [F.left(c, F.lit(1)), F.right(c, F.lit(1))]
    keyed = forms.groupBy("field_name", "stored_text").agg(F.collect_set(ascii_part("form")).alias("keys"), F.collect_set(ends("form")[0]).alias("firsts"), F.collect_set(ends("form")[1]).alias("lasts"))
    keyed = keyed.withColumn("key", F.explode("keys")).withColumn("first", F.explode("firsts")).withColumn("last", F.explode("lasts"))
    listed = entries.select("field_name", "whole", ascii_part("whole").alias("key"), ends("whole")[0].alias("first"), ends("whole")[1].alias("last")).where(F.col("whole").rlike(r"[^\x00-\x7F]"))
    pairs = keyed.join(listed, ["field_name", "key", "first", "last"]).select("field_name", "stored_text", "whole").distinct()
    return pairs.mapInPandas(follow, READING)


def restored_values(cells: DataFrame, drugs: DataFrame, events: DataFrame) -> DataFrame:
    """Garbled ``drug_text`` and ``event_pt`` of each dataset's cells with the ``ref_id`` of the listed text they were.

    A value is diagnosed once, however many datasets hold it, and comes out once for each of them.

    Of a value's readings the likeliest that is a listed text is taken, full ones before those that leave some letters; a value of which no reading is listed is a case
    only if the classifier holds a chain likelier than clean text. A value that is itself a listed text is none.
    ``ref_id`` is 0 where characters were lost, and where the restored text is in no list. Rows: ``dataset_id``,
    ``field_name``, ``stored_text``, ``ref_id``, ``chain``, ``restored``. Rows of NULL or ASCII text give nothing,
    repeated rows of a dataset one row, equal list entries the smallest id; a NULL dataset comes out as it is; empty
    tables give an empty result.
    """
    listed = drugs.select(F.lit("drug_text").alias("field_name"), F.col("drug_name").alias("entry"), "ref_id").unionByName(
        events.select(F.lit("event_pt").alias("field_name"), F.col("event_pt").alias("entry"), "ref_id")
    )
    classes, model = train(listed, "entry")
    held = cut(
        cells.select("dataset_id", F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("stored_text")) for c in ("drug_text", "event_pt")))).alias("v"))
        .select("dataset_id", "v.*")
        .where(F.col("stored_text").rlike(r"[^\x00-\x7F]"))
        .distinct()
    )
    values = held.select("field_name", "stored_text").distinct()
    entries = listed.where("entry is not null").groupBy("field_name", F.upper("entry").alias("whole")).agg(F.min("ref_id").alias("listed_id"))
    full = cut(garbled_values(values, classes, model))
    known = full.unionByName(partly_garbled(values, full, entries, classes, model))
    readings = known.withColumn("whole", F.upper("restored")).join(entries, ["field_name", "whole"], "left")
    best = readings.groupBy("field_name", "stored_text").agg(
        F.min_by(F.struct("chain", "restored", "listed_id", "likely"), F.struct(F.col("listed_id").isNull(), "rank")).alias("best")
    )
    in_order = entries.select("field_name", "whole")
    found = (
        best.withColumn("whole", F.upper("stored_text"))
        .join(in_order, ["field_name", "whole"], "left_anti")
        .where("best.listed_id is not null or best.likely")
        .select(
            "field_name",
            "stored_text",
            F.when(F.col("best.chain") == "lost", F.lit(0)).otherwise(F.coalesce("best.listed_id", F.lit(0))).cast("long").alias("ref_id"),
            F.col("best.chain").alias("chain"),
            F.col("best.restored").alias("restored"),
        )
    )
    return held.join(found, ["field_name", "stored_text"]).select("dataset_id", *found.columns)
