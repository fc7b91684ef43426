"""Mapping of freely typed values to the entries of a reference list.

Each distinct token of the typed values is repaired: a join by edit distance ties it to the tokens of the list. The
repaired tokens then rank the complete entries by soft TF-IDF. The join is an equality join of deletion variants (two
words within k edits have a common form after at most k deletions each), so that no two lists are compared pair by
pair; the edit distance of the few joined pairs is then computed exactly.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigmill.functions.ids import present
from sigmill.llm import encoding
from sigmill.runtime import cut, small, spread

#: Least similarity of a token to the list's token that it is repaired to.
TOKEN_SIMILARITY = 0.75
#: Least share of an entry's weight that the repaired tokens must cover.
ENTRY_COVERAGE = 0.75
#: What a share may lose in rounding.
ROUNDING = 1e-9
#: Edits allowed by length of the list's token: (least length, edits).
EDITS = ((12, 3), (8, 2), (5, 1), (0, 0))
#: Deletions on which the variants join. Three edits within two deletions each are reached through the halves of a word.
DELETIONS = 2
#: Least letters of a token that is read as the beginning of a longer one.
CUT_LETTERS = 6
#: Least letters of a token that takes part.
TOKEN_LETTERS = 3

# fixed values: letters that do not decompose
PLAIN = str.maketrans({"Ø": "O", "Ł": "L", "Đ": "D", "Ð": "D", "Þ": "TH", "Æ": "AE", "Œ": "OE", "ß": "SS", "ẞ": "SS", "ı": "I"})
# fixed values: spellings that sound alike, applied in this order
SOUNDS = (("PH", "F"), ("AU", "O"), ("KS", "X"), ("CK", "K"), ("QU", "KW"), ("Q", "K"), ("C", "K"), ("Y", "I"), ("Z", "S"), ("W", "V"))
_TOKEN = re.compile(r"[A-Z0-9�]+")
_LOOKALIKE = str.maketrans({"0": "O", "1": "I", "3": "E", "5": "S", "4": "A", "7": "T", "8": "B"})


def plain(text: str) -> str:
    """Upper case without accents; the substitute character stays as a letter of its own."""
    text = unicodedata.normalize("NFKD", text.upper()).translate(PLAIN)
    return "".join(c for c in text if not unicodedata.combining(c))


def spelling(token: str) -> str:
    """What the token's tokens are compared by besides their letters: sounds unified, doubled letters once."""
    if any(c.isdigit() for c in token) and sum(c.isalpha() for c in token) >= 3:
        token = token.translate(_LOOKALIKE)
    for a, b in SOUNDS:
        token = token.replace(a, b)
    return "".join(c for c, _ in itertools.groupby(token))


def distances(first: list[str], second: list[str], most: np.ndarray) -> np.ndarray:
    """Edits (insertion, deletion, change, exchange of neighbours) between the words of each pair; ``most`` + 1 if more.

    All pairs of a slice go through the table of prefixes together, one array operation a cell and kind of edit. Pairs
    whose lengths differ too much are not compared; slices are of like lengths, so that padding stays small.
    """
    sizes = np.array([[len(a), len(b)] for a, b in zip(first, second)], np.int64).reshape(-1, 2)
    out = np.asarray(most, np.int64) + 1
    order = np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) < out)
    order = order[np.argsort(sizes[order].max(1), kind="stable")]
    low = 0
    while low < len(order):
        width = int(sizes[order[low]].max()) + 8
        high = low + max(1, min(len(order) - low, (1 << 22) // (width * width)))
        high = low + max(1, int(np.searchsorted(sizes[order[low:high]].max(1), width, "right")))
        rows = order[low:high]
        out[rows] = np.minimum(_table([first[r] for r in rows], [second[r] for r in rows], sizes[rows]), out[rows])
        low = high
    return out


def _letters(words: list[str], width: int) -> np.ndarray:
    """The words' characters as numbers, a row a word."""
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def _table(first: list[str], second: list[str], sizes: np.ndarray) -> np.ndarray:
    height, width = (int(n) for n in sizes.max(0))
    a, b = _letters(first, height), _letters(second, width)
    rows = [np.broadcast_to(np.arange(width + 1)[:, None], (width + 1, len(first)))]
    found = np.where(sizes[:, 0] == 0, sizes[:, 1], 0)
    for i in range(1, height + 1):
        now = np.empty((width + 1, len(first)), np.int64)
        now[0] = i
        same = a[:, i - 1, None] == b
        for j in range(1, width + 1):
            np.minimum(np.minimum(rows[-1][j], now[j - 1]) + 1, rows[-1][j - 1] + ~same[:, j - 1], out=now[j])
            if i > 1 and j > 1:
                swapped = same[:, j - 2] & (a[:, i - 2] == b[:, j - 1])
                np.minimum(now[j], np.where(swapped, rows[-2][j - 2] + 1, now[j]), out=now[j])
        ended = sizes[:, 0] == i
        found[ended] = now[sizes[ended, 1], np.flatnonzero(ended)]
        rows = [rows[-1], now]
    return found


def edits(length: int) -> int:
    return next(k for least, k in EDITS if length >= least)


def similarities(tokens: list[str], entries: list[str]) -> np.ndarray:
    """1 for equal tokens, less by edits of letters or, slightly worse, of sounds; 0 beyond the edits allowed. By pair."""
    most = np.array([edits(len(e)) for e in entries], np.int64)
    spelt = [(spelling(a), spelling(b)) for a, b in zip(tokens, entries)]
    changed = np.array([0.25 if x != a or y != b else 0.0 for (x, y), a, b in zip(spelt, tokens, entries)])
    heard = distances([x for x, _ in spelt], [y for _, y in spelt], most) + changed
    best = np.minimum(distances(tokens, entries, most), heard)
    length = np.array([max(len(a), len(b), 1) for a, b in zip(tokens, entries)])
    equal = np.array([a == b for a, b in zip(tokens, entries)], bool)
    return np.where(equal, 1.0, np.where(best > most, 0.0, 1.0 - best / length))


def variants(token: str, deletions: int) -> set[str]:
    """Forms of a token and of its spelling after at most so many deletions."""
    found = set()
    for form in {token, spelling(token)}:
        level = {form}
        found |= level
        for _ in range(min(deletions, max(0, len(form) - 2))):
            level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
            found |= level
    return found


def entry_halves(entry: str) -> set[str]:
    """Beginnings and ends of a list's token that allows more edits than ``DELETIONS`` reach, each within one deletion.

    Of three edits at most one falls into one of the halves. Two cuts, as an exchange of neighbours may lie across one.
    Edits of sounds count a quarter more, so that no more than ``DELETIONS`` of them are ever allowed.
    """
    if edits(len(entry)) <= DELETIONS:
        return set()
    middle = len(entry) // 2
    return set().union(*(_ends(entry, size, len(entry) - size) for size in (middle, middle + 1)))


def token_halves(token: str) -> set[str]:
    """All that a token within three edits of a list's token can have in common with its ``entry_halves``."""
    beginnings, ends = set(), set()
    for size in range(len(token) - 3, len(token) + 4):
        if edits(max(0, size)) > DELETIONS:
            middle = size // 2
            beginnings |= set(range(middle - 1, middle + 3))
            ends |= set(range(size - middle - 2, size - middle + 2))
    return set().union(*(_ends(token, n, 0) for n in beginnings), *(_ends(token, 0, n) for n in ends))


def _ends(word: str, beginning: int, end: int) -> set[str]:
    found = set()
    for tag, part in (("<", word[:beginning]), (">", word[len(word) - end :])):
        if part:
            found |= {tag + part, *(tag + part[:i] + part[i + 1 :] for i in range(len(part)))}
    return found


def tokens_of(texts: DataFrame, session_model: tuple, joined: bool = True) -> DataFrame:
    """Tokens of each text (``text``, ``reading``, ``token``), of the text as stored and of all its other readings.

    Two neighbouring tokens also count as one, as blanks and points stand inside words. A text that was decoded
    wrongly is read in every way that ``encoding.diagnose`` finds, the likeliest first; their number is bounded by the
    chains. Readings that differ only in accents are one.
    """
    shared = texts.sparkSession.sparkContext.broadcast(session_model)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, model = shared.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = sorted(encoding.diagnose(text, classes, model), key=lambda r: r[2])
                readings = dict.fromkeys(plain(r) for r in (text, *(r for c, r, _, _ in found if c != "lost")))
                for n, reading in enumerate(readings):
                    parts = _TOKEN.findall(reading)
                    words = {p for p in parts if len(p) >= TOKEN_LETTERS and not p.isdigit()}
                    if joined:
                        words |= {a + b for a, b in zip(parts, parts[1:]) if len(a + b) >= 6 and not a.isdigit() and not b.isdigit()}
                    rows += [(text, n, w) for w in words]
            yield pd.DataFrame(rows, columns=["text", "reading", "token"])

    return spread(texts).mapInPandas(split, "text string, reading int, token string")


def partly_garbled_tokens(texts: DataFrame, forms: DataFrame, model: tuple) -> DataFrame:
    """Tokens, as of the first reading, of words that are a listed word with only some of their letters garbled."""
    words = lambda c: F.explode(F.split(c, r"\s+"))
    held = texts.select("text", words(F.col("text")).alias("stored_text")).where(F.col("stored_text").rlike(r"[^\x00-\x7F]")).distinct()
    listed = forms.select(F.lit("").alias("field_name"), words(F.upper("form")).alias("whole")).distinct()
    values = cut(held.select(F.lit("").alias("field_name"), "stored_text").distinct())
    found = encoding.partly_garbled(values, encoding.garbled_values(values, *model), listed, *model)
    known = held.join(found.select("stored_text", "restored").distinct(), "stored_text")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(text, 0, w) for text, word in zip(batch["text"], batch["restored"]) for w in _TOKEN.findall(plain(word)) if len(w) >= TOKEN_LETTERS and not w.isdigit()]
            yield pd.DataFrame(rows, columns=["text", "reading", "token"])

    return known.select("text", "restored").mapInPandas(split, "text string, reading int, token string")


def _with_variants(df: DataFrame, column: str, halves: Callable[[str], set[str]]) -> DataFrame:
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                rows = [(t, v) for t in batch[column].iloc[low : low + 500] for v in (*variants(t, DELETIONS), *halves(t))]
                yield pd.DataFrame(rows, columns=[column, "variant"])

    return spread(df.select(column).distinct()).mapInPandas(expand, f"{column} string, variant string")


def repairs(tokens: DataFrame, entry_tokens: DataFrame, least: float = TOKEN_SIMILARITY) -> DataFrame:
    """``token``, ``entry_token`` and ``similarity`` of the distinct tokens and the list's tokens that are close enough."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["similarity"] = similarities(batch["token"].tolist(), batch["entry_token"].tolist())
            yield batch[batch["similarity"] >= least]

    pairs = _with_variants(tokens, "token", token_halves).join(_with_variants(entry_tokens, "entry_token", entry_halves), "variant").select("token", "entry_token").distinct()
    close = spread(pairs).mapInPandas(measure, "token string, entry_token string, similarity double")
    return close.unionByName(cut_short(tokens, entry_tokens))


def cut_short(tokens: DataFrame, entry_tokens: DataFrame) -> DataFrame:
    """Tokens that are the beginning, at least half and ``CUT_LETTERS`` letters, of exactly one token of the list."""
    whole = entry_tokens.select("entry_token").distinct().withColumn("size", F.length("entry_token"))
    lengths = F.sequence(F.greatest(F.lit(CUT_LETTERS), F.ceil(F.col("size") / 2).cast("int")), F.col("size") - 1)
    beginnings = whole.where((F.col("size") > CUT_LETTERS)).select("entry_token", F.explode(lengths).alias("n")).select("entry_token", F.expr("left(entry_token, n)").alias("token"))
    alone = beginnings.groupBy("token").agg(F.count("*").alias("found"), F.min("entry_token").alias("entry_token")).where("found = 1")
    share = F.length("token") / F.length("entry_token")
    return tokens.select("token").distinct().join(alone, "token").select("token", "entry_token", F.greatest(F.lit(TOKEN_SIMILARITY), share.cast("double")).alias("similarity"))


def map_values(texts: DataFrame, entries: DataFrame, model: tuple, least: float = ENTRY_COVERAGE) -> DataFrame:
    """``text``, ``ref_id`` and ``score`` of every distinct text; ``ref_id`` is 0 where it means no entry.

    ``texts`` has ``text``; ``entries`` has ``ref_id`` and ``form`` (a name by which the entry goes). Tokens are weighed
    by how few forms of the list have them. A form counts if its tokens are covered to at least ``least``; the form
    with the largest covered weight is taken, of equal ones that with the better coverage, then the smaller ``ref_id``.
    NULL texts give nothing; an empty text and one without tokens means no entry; repeated rows give one row; NULL and
    empty forms are no forms; with an empty list everything means none.
    """
    forms = entries.where("form is not null and trim(form) <> ''").select("ref_id", "form").distinct()
    form_tokens = tokens_of(forms.select(F.col("form").alias("text")).distinct(), model, joined=False).where("reading = 0")
    form_tokens = cut(form_tokens.join(forms.withColumnRenamed("form", "text"), "text").select("ref_id", "text", F.col("token").alias("entry_token")))
    count = forms.select("form").distinct().count()
    weights = form_tokens.groupBy("entry_token").agg(F.log(1 + F.lit(float(max(count, 1))) / F.count_distinct("text")).alias("weight"))
    weighed = form_tokens.join(weights, "entry_token").withColumn("total", F.sum("weight").over(Window.partitionBy("ref_id", "text")))
    distinct = texts.select("text").where("text is not null").distinct()
    typed = cut(tokens_of(distinct, model).unionByName(partly_garbled_tokens(distinct, forms, model)).distinct())
    near = repairs(typed, form_tokens)
    best = cut(typed.join(near, "token").groupBy("text", "reading", "entry_token").agg(F.max("similarity").alias("similarity")))
    # a form that is covered has one of its heaviest tokens, those that together weigh more than may be missing
    ahead = Window.partitionBy("ref_id", "text").orderBy(F.col("weight").desc(), "entry_token").rowsBetween(Window.unboundedPreceding, -1)
    weighed = cut(weighed.withColumn("ahead", F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))).withColumnRenamed("text", "form"))
    prefix = weighed.where(F.col("ahead") <= F.col("total") * (1 - least + ROUNDING))
    candidates = best.join(small(prefix.select("ref_id", "form", "entry_token")), "entry_token").select("text", "reading", "ref_id", "form").distinct()
    scores = (
        candidates.join(small(weighed.drop("ahead")), ["ref_id", "form"])
        .join(best, ["text", "reading", "entry_token"])
        .groupBy("text", "reading", "ref_id", "form")
        .agg(F.sum(F.col("weight") * F.col("similarity")).alias("mass"), F.max("total").alias("total"))
        .withColumn("coverage", F.col("mass") / F.col("total"))
        .where(F.col("coverage") >= least - ROUNDING)
    )
    top = scores.groupBy("text").agg(F.max_by(F.struct("ref_id", "coverage"), F.struct("mass", "coverage", -F.col("ref_id"))).alias("top"))
    return distinct.join(top, "text", "left").select("text", F.coalesce("top.ref_id", F.lit(0)).cast("long").alias("ref_id"), F.col("top.coverage").alias("score"))


def typed_names(cells: DataFrame, drugs: DataFrame) -> DataFrame:
    """``dataset_id``, ``drug_text``, ``ref_id`` of the cells' product names that aren't letter for letter in the list."""
    names = drugs.select("ref_id", F.explode(F.array("drug_name", "brand_name")).alias("form")).select("ref_id", present(F.col("form")).alias("form"))
    listed = names.where("form is not null").select(F.col("form").alias("drug_text")).distinct()
    source = F.upper(F.regexp_replace("drug_text_source", r"[^A-Za-z0-9]+", ""))
    cases = cells.where(source == "DRUGNAME").select("dataset_id", "drug_text").distinct().join(listed, "drug_text", "left_anti")
    cases = cut(cases.where("drug_text is not null"))
    model = encoding.train(drugs, "drug_name")
    mapped = map_values(cases.select(F.col("drug_text").alias("text")), names, model)
    return cases.join(mapped.withColumnRenamed("text", "drug_text"), "drug_text").select("dataset_id", "drug_text", "ref_id", "score")
