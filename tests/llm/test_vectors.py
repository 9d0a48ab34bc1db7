import numpy as np
import pytest

from quillon.llm import vectors

from .conftest import components


def corpus(n=240, dim=16):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, dim))
    rows = []
    for i in range(n):
        x = base[rng.integers(40)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.12, 1.0])
        rows.append((i, (x * rng.choice([1e-3, 1.0, 1e4])).astype(np.float32).tolist(), int(rng.integers(2))))
    zero = [0.0] * dim
    bad = [None, zero, [None, *zero[1:]], [float("nan"), *zero[1:]], [float("inf"), *zero[1:]]]
    rows += [(1000 + i, x, 1) for i, x in enumerate(bad)] + [(2000, rows[0][1], None), (2001, rows[0][1], rows[0][2]), (2002, rows[1][1], rows[1][2])]
    return rows


def brute(rows):
    fine = [(i, np.array(x, np.float64), k) for i, x, k in rows if k is not None and x is not None and None not in x and np.isfinite(x).all() and any(x)]
    edges = [(a, b) for a, x, k in fine for b, y, m in fine if a > b and k == m and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98]
    root = components([r[0] for r in rows], edges)
    n = dict.fromkeys(root, 0)
    for e in edges:
        for i in e:
            n[i] += 1
    return n, root


@pytest.mark.parametrize("cluster_rows", [1000, 20])
def test_links(spark, cluster_rows):
    rows = corpus()
    n, root = brute(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, key int")
    out = vectors.near_duplicates(df, cluster_rows=cluster_rows)
    got = {r.vec_id: r for r in out.collect()}
    assert set(got) == set(n)
    assert all(got[i].n_links <= n[i] for i in n) and sum(r.n_links for r in got.values()) >= 0.97 * sum(n.values()) > 0
    assert sum(got[i].component_id != root[i] for i in root) <= 0.03 * len(root)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 2000))
    assert vectors.audit_recall(df, out) >= 0.97


def test_a_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.02).tolist(), 1) for i in range(100)]
    n, _ = brute(rows)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n.values()) and {r.component_id for r in got.values()} == {0}


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_a_label_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(vectors.centroids, "__defaults__", (20, vectors.CLUSTER_ROWS))
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(400)]
    x = rng.normal(size=8).tolist()
    rows += [(1000 + i, (np.array(x) * (1 + i)).tolist(), 2 + i // 2) for i in range(6)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == 406 and [got[1000 + i].component_id for i in range(6)] == [1000, 1000, 1002, 1002, 1004, 1004]


def _groups(groups, size, pairs, seed, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups + pairs, dim))
    of = np.r_[np.repeat(np.arange(groups), size), np.repeat(np.arange(groups, groups + pairs), 2)]
    x = base[of] + rng.normal(size=(len(of), dim)) * 0.03
    return x / np.linalg.norm(x, axis=1, keepdims=True), of


def test_groups_larger_than_the_nearest_looked_at():
    for groups, size, pairs in ((1, 500, 500), (20, 70, 0), (10, 100, 200)):
        x, of = _groups(groups, size, pairs, 7)
        graph = vectors.with_reverse([[j for j in own if j != i] for i, own in enumerate(vectors.prune(x).tolist())])
        reached = np.zeros(len(x), bool)
        reached[vectors.starts(x, graph)] = True
        for _ in range(len(x)):
            reached[graph[reached]] = True
        assert reached.all()
        true = x @ x.T >= 0.98
        y = x.astype(np.float32)
        for own in (True, False):  # as a block of its own, and as another block's vectors ask
            found = vectors.search(y, graph, y, 0.98, own=own) & true
            recall = (found | found.T).sum(1) / true.sum(1)
            print(groups, size, pairs, own, recall.mean(), recall.min())
            assert recall.mean() >= (0.99 if own else 0.95)


def test_recall_by_vector_with_skewed_labels(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 400)
    x, _ = _groups(4, 150, 150, 8)
    rows = [(i, v.tolist(), 1 if i % 10 else 2) for i, v in enumerate(x)]
    labels = np.array([r[2] for r in rows])
    true = ((x @ x.T >= 0.98) & (labels[:, None] == labels)).sum(1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    share = [got[i] / n for i, n in enumerate(true) if n]
    print(np.mean(share))
    assert max(share) <= 1 and np.mean(share) >= 0.97


def test_a_vector_meets_as_many_others_in_a_larger_table(spark):
    met = {}
    for n in (1000, 4000):
        x = np.random.default_rng(9).normal(size=(n, 16))
        df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "label int, key long, embedding array<double>")
        c = vectors.centroids(df)[1]
        top = np.argsort(-(vectors._unit(x) @ c.T), 1)[:, : vectors.OVERLAP]
        met[n] = (np.bincount(top.ravel()) ** 2).sum() / n
    assert met[4000] < 1.6 * met[1000]
