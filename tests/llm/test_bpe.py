import random

import numpy as np
import pytest

from quillon.llm import bpe
from quillon.llm.queries import vocabulary

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def oracle():
    path, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={}).encode_ordinary


def texts():
    rng = random.Random(2)
    parts = ["a", "The", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "é", "ß", "1", "²", "५", "'s", "'LL", "!", "🙂", "漢", "́", "ǅ", "_", "﻿", "x" * 50, "ab" * 300, "\x00", "\r\n", "的" * 200, "<|endoftext|>"]
    fixed = [None, "", " ", "a" * 3000, " " * 500, "word " * 5000, "one  two \n three", "Hello, world! It's"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] * 2  # repeated rows


@pytest.mark.parametrize("broadcast", [bpe.BROADCAST_BYTES, 0])
def test_ids_are_the_librarys(spark, oracle, broadcast):
    rows = texts()
    df = spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(rows)], "doc_id long, text string, lang string, IDS int")
    out = bpe.encode(df, *vocabulary(), decode_too=True, broadcast_bytes=broadcast)
    assert out.columns == ["doc_id", "lang", "ids", "decoded"]
    got = bpe.decode(out.drop("decoded"), vocabulary()[0]).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == oracle(text) and r.decoded == text.encode()
    assert {r.decoded for r in out.select("decoded").collect()} == {(t or "").encode() for t in rows}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    for broadcast in (bpe.BROADCAST_BYTES, 0):
        assert bpe.encode(df, *vocabulary(), broadcast_bytes=broadcast).collect() == []


def test_long_words_merge_alike(oracle):
    ranks = bpe.read_ranks(vocabulary()[0])
    for word in ("a" * 999, "abcabcx" * 80, "thethere" * 99, "é" * 321):
        assert bpe.merge_long(word.encode(), ranks) == oracle(word)


def test_the_plan_of_the_fold_holds_no_rank_map(spark):
    """It would be parsed, printed and logged by the driver; and no row holds the tables either."""
    path, _ = vocabulary()
    ranks = bpe.rank_tables(spark, path)
    plan = bpe.dictionary(spark.createDataFrame([(b"the",)], "word binary"), path, ranks)._jdf.queryExecution()
    assert len(plan.toString()) < 100_000
    assert "AS ids" in plan.optimizedPlan().toString() and "AS ranks" not in plan.optimizedPlan().toString()
