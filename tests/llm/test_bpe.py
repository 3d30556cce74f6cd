import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, tokens

FOLDER = tokens.TOKENIZERS
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.json"), reason="no vocabulary files here")

TEXTS = [
    "", " ", "\n", "'s", "don't 'tis ''s 'll've x'rest it'S we'RE 'sam' I'm'd ab'd.", "a  b\n\n c\t\td   ", " x y　", "é" * 700, "abc" * 3000, "z" * 5000, "\x00\x00ab",
    "<|endoftext|>", "日本語テキスト 123４５ ½²", "x\x1c\x1d y", "1\r\n00:00:01,616 --> 00:00:07,014\r\nWhere were you?\r\n", "﻿naïve café", "👩‍👩‍👧 emoji 🎵", "ааа" * 50, "a" * 16 + " " + "b" * 17 + " cccccccc ddddddddd",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def run(encoder, texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in data])]).astype(np.int64)
    ids, counts = encoder.encode(b"".join(data), offsets)
    assert encoder.count(b"".join(data), offsets).tolist() == counts.tolist()
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_equals_the_library(reference):
    encoder = bpe.Encoder(bpe.load_vocabulary(f"{FOLDER}/byte_bpe_50k.json"))
    for _ in range(2):  # the second time from the words it keeps
        assert run(encoder, TEXTS) == reference(TEXTS)
    rng = random.Random(3)
    alphabet = "aeinrst'.,  \n\t-0129éßшф日🎵 DLM"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)]
    assert run(encoder, texts) == reference(texts)


def test_cache_may_start_anew(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    encoder = bpe.Encoder(bpe.load_vocabulary(f"{FOLDER}/byte_bpe_50k.json"))
    for text in TEXTS:
        assert run(encoder, [text, "more words of this"]) == reference([text, "more words of this"])


def test_rank_file_gives_the_same_merges():
    a, b = (bpe.load_vocabulary(f"{FOLDER}/byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    assert (a.byte_ids == b.byte_ids).all()
    assert {*zip(a.left.tolist(), a.right.tolist(), a.merged.tolist())} == {*zip(b.left.tolist(), b.right.tolist(), b.merged.tolist())}


def test_documents(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (None, "no key", "x"), (3, "twice", "x")]
    df = spark.createDataFrame(rows, "key long, text string, ids string").repartition(3)
    got = sorted(((r.key, r.ids) for r in tokens.encode(df, "key", "text").collect()), key=str)
    assert got == sorted(((k, ids) for (k, _, _), ids in zip(rows, reference([t or "" for _, t, _ in rows]))), key=str)
    counted = tokens.count(df, "text", keep=("key",)).collect()
    assert sorted((r.key, r.tokens) for r in counted if r.key is not None) == sorted((k, len(i)) for k, i in got if k is not None)
    assert tokens.encode(df.limit(0), "key", "text").count() == 0
    assert tokens.encode(df, "key", "text").where(F.col("ids").isNull()).count() == 0
