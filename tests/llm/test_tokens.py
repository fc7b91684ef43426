import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigmill.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY_FILE), reason="no vocabulary file")
POOL = ["'s", "'ll", "'re", "'t", " ", "  ", "\n", "\t", "a", "Ab", "9", "½", "é", "é", "日本", "🙂", "\x1c", "\x1b", "\x85", "\xa0", " ", "​", "'", '"', "\r\n", "<|endoftext|>", "'S", "_", "--", "﻿", "　", "ก็", "١"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.VOCABULARY_FILE)
    found.encode_special_tokens = True
    return found


def lists(texts, vocabulary):
    ids, counts = bpe.encode_texts(pa.array(texts, pa.string()), vocabulary)
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts)]


def test_random_texts_as_the_library(vocabulary, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["a" * 5000, "-" * 300, " " * 500, "ab" * 999, "", " ", "'", "it's 'll", "\n\n x\n"]
    assert lists(texts, vocabulary) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_slices_of_any_size_agree(vocabulary, monkeypatch):
    texts = ["one two", None, "", "three's a crowd " * 50, "x"] * 7
    whole = lists(texts, vocabulary)
    for size in (1, 13, 500):
        monkeypatch.setattr(bpe, "SLICE_BYTES", size)
        assert lists(texts, vocabulary) == whole


def test_pair_check_and_exact_merging(vocabulary):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 12))) for _ in range(300)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    ids, counts = vocabulary.encode_words(data, ends - [len(w) for w in words], ends)
    at = 0
    for word, count in zip(words, counts):
        exact = vocabulary.merge(word.encode())
        assert ids[at : at + count].tolist() == exact
        pairs = np.array(exact[:-1]), np.array(exact[1:])
        assert len(exact) < 2 or vocabulary.compatible(*pairs).all()
        at += count


def test_column(spark, library):
    rows = [(1, "Hello world", 9, "x"), (2, None, 9, "x"), (3, "", 9, "x"), (None, "Hello world", 9, "x"), (1, "Hello world", 9, "x"), (4, "long " * 30000, 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, key string")
    got = bpe.encode_column(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    found = sorted(((r.doc_id or 0), r.ids) for r in got.collect())
    hello = library.encode("Hello world", add_special_tokens=False).ids
    assert found[:5] == [(0, hello), (1, hello), (1, hello), (2, []), (3, [])]
    assert found[5][1] == library.encode("long " * 30000, add_special_tokens=False).ids
    assert bpe.encode_column(df.limit(0)).count() == 0 and bpe.encode_column(df.withColumn("text", F.lit(None).cast("string"))).where("size(ids) > 0").count() == 0
