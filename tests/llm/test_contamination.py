import random
import re

import pytest

from sigmill.llm import contamination


def brute(docs, items, run=13):
    words = lambda t: re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    where = {}
    for k, t in items:
        w = words(t)
        for i in range(len(w) - run + 1):
            where.setdefault(tuple(w[i : i + run]), set()).add(k)
    return {(d, k) for d, t in docs for w in [words(t)] for i in range(len(w) - run + 1) for k in where.get(tuple(w[i : i + run]), ())}


def made():
    rng = random.Random(2)
    word = lambda: rng.choice(["é", "alpha", "Beta", "7", "x9", "gamma", "delta", "rho"]) if rng.random() < 0.5 else f"w{rng.randint(0, 400)}"
    items = [(n, " ".join(word() for _ in range(rng.randint(8, 60)))) for n in range(25)] + [(90, None), (91, ""), (92, "short"), (None, "q " * 20)]
    items += [(93, items[0][1]), (94, "a b " * 30)]
    docs = [(n, " ".join(word() for _ in range(rng.randint(0, 200)))) for n in range(40)]
    for n in range(40, 90):
        text = rng.choice(items[:25])[1].split(" ")
        low = rng.randint(0, max(0, len(text) - 11))
        cut = text[low : low + rng.randint(10, 30)]
        joiner = rng.choice([" ", "\n# ", " -- ", "*", "é"])
        docs.append((n, "start " * rng.randint(0, 5) + joiner.join(cut).upper() + " end" * rng.randint(0, 3)))
    return docs + [(200, None), (201, ""), (202, "b a " * 40), (40, docs[40][1]), (None, "q " * 13), (203, "pad " * 50000 + items[1][1])], items


@pytest.mark.parametrize("filter_shingles", [contamination.FILTER_SHINGLES, 3000])
def test_against_brute_force(spark, filter_shingles):
    docs, items = made()
    d = spark.createDataFrame([(*x, 1, "w") for x in docs], "doc_id long, text string, item_id int, words string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in contamination.leaked_items(d, i, filter_shingles=filter_shingles).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)
    assert len(got) > 20


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")
    assert contamination.leaked_items(d, i).count() == 1
    assert contamination.leaked_items(d.limit(0), i).count() == contamination.leaked_items(d, i.limit(0)).count() == 0


def test_slices_of_any_size_agree(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["one two three four five six", None, "", "seven"] * 5)
    whole = sum(len(contamination.Words(d, b, 5).shingles[contamination.Words(d, b, 5).whole]) for _, d, b in contamination._slices(texts))
    monkeypatch.setattr(contamination, "SLICE_BYTES", 3)
    small = [contamination.Words(d, b, 5) for _, d, b in contamination._slices(texts)]
    assert sum(int(w.whole.sum()) for w in small) == whole == 10
    assert len({int(s) for w in small for s in w.shingles[w.whole]}) == 2 and np.all([w.text(0, 2) in ("one two", "seven") for w in small])
