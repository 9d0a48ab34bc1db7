import random

import numpy as np
import pytest

from quillon.llm import ngrams

from .conftest import components


def shingles(text, n=5):
    w = (text or "").lower().split()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    edges, n = [], [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                edges.append((i, j))
                n[i] += 1
                n[j] += 1
    root = components(range(len(rows)), edges)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root[i]] = min(low.get(root[i], d), d)
    return [(d, low.get(root[i]) if sets[i] else d, n[i]) for i, (d, _) in enumerate(rows)]


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.randrange(1, 8)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "  \n", "one", "ONE", "one two three", "one two three four five six", "long " * 20_000, "long " * 19_999])]
    return rows + [rows[0], (None, rows[3][1]), (None, "alone and unnamed")]


def test_links_and_classes(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, band int")
    got = sorted(map(tuple, ngrams.join(df).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_a_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK_ROWS", 7)
    rng = random.Random(7)
    base = [f"w{rng.randrange(99)}" for _ in range(150)]
    rows = [(i, " ".join(base[: i % 140] + [f"own{i}"] + base[i % 140 + 1 :])) for i in range(60)]
    assert sorted(map(tuple, ngrams.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == sorted(brute(rows))


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en", d) for d, t in rows], "doc_id long, text string, lang string, key long")
    kept = ngrams.keep_one(df)
    assert kept.columns == df.columns
    want = {(d, t) for (d, t), (_, c, _) in zip(rows, brute(rows)) if d == c}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(None, "alone and unnamed")}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngrams.join(df).collect() == [] and ngrams.keep_one(df).collect() == []


def test_bands_reach_the_recall():
    bands, rows = ngrams.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= ngrams.TARGET_RECALL and bands * rows <= ngrams.MOST_HASHES


@pytest.mark.parametrize("seed", range(3))
def test_intersections(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120))).astype(np.uint64) for _ in range(50)]
    got = ngrams.intersections(sets)
    for i in range(50):
        for j in range(50):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
