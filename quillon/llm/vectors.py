"""Embedding near-dedup over a robust-pruned flat graph.

Vectors are compared within a label. Each goes to its nearest clusters (they overlap);
a cluster's members form blocks of bounded size. Every block builds a graph of its own,
neighbours robustly pruned; a vector's adjacency lists from its blocks are united. A
pair of blocks is then searched by one task: greedy search from start nodes that reach all
others (and from a vector's own node, in its own block), for all vectors side by side, then
expanded through whatever lies in range. Links found are
verified in double precision. Tasks return counts and spanning forests, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import paired_rows, settle, small_batches, summarize_links
from .ngrams import forest

SIMILARITY = 0.98
OVERLAP = 2
#: Few, so that a label of a thousand rows has several clusters already: from there on each vector meets as many others in a table of any size.
CLUSTER_ROWS = 250
#: Centroids of all labels together, and the sample they are fitted on, are bounded.
MOST_CENTROIDS = 4096
SAMPLE = 20_000
BLOCK_ROWS = 1500
DEGREE = 20
#: Neighbours of each vector from all over its block, besides the near ones; with reverse edges a node has up to WIDEST.
FAR = 4
WIDEST = 3 * DEGREE
#: Start nodes spread over a block, besides those that reach all others.
SEEDS = 32
BEAM = 24
#: Search goes on through nodes so much below the range.
SLACK = 0.02


def usable() -> Column:
    """Whether a row has a label and a vector that has a direction: no null, no element null or not finite, not all zero."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def centroids(classes: DataFrame, most: int = SAMPLE, cluster_rows: int = CLUSTER_ROWS) -> dict:
    """By label: unit centroids, one for each cluster_rows rows, fitted on a bounded sample; a label without rows in it isn't there."""
    sizes = dict(classes.groupBy("label").count().collect())
    total = sum(sizes.values())
    want = {k: max(1, min(round(n / cluster_rows), MOST_CENTROIDS * n // total)) for k, n in sizes.items()}
    sample = classes.select("label", "key", "embedding").orderBy(F.xxhash64("key")).limit(most).collect()
    out = {}
    for label, k in want.items():
        own = [r.embedding for r in sample if r.label == label]
        if not own:
            continue
        x = _unit(own)
        c = x[: min(k, len(x))]
        for _ in range(6):
            nearest = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, nearest, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
        out[label] = c.astype(np.float32)
    return out


def _unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that neither tiny nor huge vectors lose their norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prune(x: np.ndarray, degree: int = DEGREE, alpha: float = 1.2, far: int = FAR) -> np.ndarray:
    """Robust-pruned neighbours of each vector, padded by itself: a candidate goes if a kept neighbour is alpha times nearer to it.

    ``degree`` of them come from the nearest, and ``far`` from the others, which a group of near vectors would not let in.
    """
    n = len(x)
    similarity = x @ x.T
    np.fill_diagonal(similarity, -2)
    width = min(n - 1, 3 * degree)
    if width < 1:
        return np.repeat(np.arange(n)[:, None], degree, 1)
    order = np.argsort(-similarity, 1, kind="stable")[:, : n - 1]
    chosen = [_chosen(similarity, order[:, :width], degree, alpha)]
    if n - 1 > width:
        # Other places for each row, so that the far edges of a group lead to different ones.
        step = (n - 1 - width) / width if n - 1 > 2 * width else 1
        at = width + ((np.arange(min(width, n - 1 - width)) * step).astype(int) + np.arange(n)[:, None]) % (n - 1 - width)
        chosen.append(_chosen(similarity, np.take_along_axis(order, at, 1), far, alpha))
    return np.hstack(chosen)


def _chosen(similarity: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    n, width = near.shape
    out = np.repeat(np.arange(n)[:, None], degree, 1)
    distance = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(similarity, near, 1)))
    open_ = np.ones((n, width), bool)
    rows = np.arange(n)
    for slot in range(degree):
        has = open_.any(1)
        if not has.any():
            break
        best = open_.argmax(1)
        chosen = near[rows, best]
        out[has, slot] = chosen[has]
        to_chosen = np.sqrt(np.maximum(0, 2 - 2 * similarity[chosen[:, None], near]))
        open_ &= alpha * to_chosen > distance
        open_[rows, best] = False
    return out


def with_reverse(lists: list[list[int]], widest: int = WIDEST) -> np.ndarray:
    """The graph of the lists, padded by the nodes themselves, with reverse edges while a node has under ``widest``."""
    both = [list(own) for own in lists]
    for i, own in enumerate(lists):
        for j in own:
            if len(both[j]) < widest:
                both[j].append(i)
    wide = max(1, max(map(len, both)))
    return np.array([(own + [i] * wide)[:wide] for i, own in enumerate(both)])


def starts(x: np.ndarray, graph: np.ndarray, seeds: int = SEEDS) -> np.ndarray:
    """Nodes from which the graph's edges lead to every node: the medoid, then that of what is not reached yet; and some spread ones."""
    n = len(x)
    reached = np.zeros(n, bool)
    out = []
    while not reached.all():
        left = np.flatnonzero(~reached)
        front = left[[int((x[left] @ x[left].mean(0)).argmax())]]
        out.append(int(front[0]))
        while len(front):
            reached[front] = True
            front = np.unique(graph[front])
            front = front[~reached[front]]
    return np.unique([*out, *range(0, n, max(1, n // seeds))])


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, radius: float, beam: int = BEAM, own: bool = False) -> np.ndarray:
    """A matrix of queries by nodes: whether range-expanding greedy search from starts() found the node within radius.

    own: the queries are the nodes, in order, and each search starts from its own node too.
    """
    n, q = len(x), len(queries)
    first_ = starts(x, graph)
    beam = min(beam, n)
    seen = np.zeros((q, n), bool)
    score = np.full((q, n), -np.inf, np.float32)
    rows = np.arange(q)
    seen[:, first_] = True
    score[:, first_] = queries @ x[first_].T
    if own:
        seen[rows, rows] = True
        score[rows, rows] = np.einsum("rd,rd->r", queries, x)
    listed = np.argpartition(-score, beam - 1, 1)[:, :beam]
    value = np.take_along_axis(score, listed, 1)
    done = value == -np.inf
    active = rows
    while len(active):
        at = np.where(done[active], -np.inf, value[active]).argmax(1)
        node = listed[active, at]
        done[active, at] = True
        neighbours = graph[node]
        fresh = ~seen[active[:, None], neighbours]
        seen[active[:, None], neighbours] = True
        got = np.einsum("ard,ad->ar", x[neighbours], queries[active])
        first = score[active[:, None], neighbours] == -np.inf
        score[active[:, None], neighbours] = got
        got = np.where(fresh & first, got, -np.inf)
        every, names = np.hstack([value[active], got]), np.hstack([listed[active], neighbours])
        over = np.hstack([done[active], ~fresh])
        top = np.argpartition(-every, beam - 1, 1)[:, :beam]
        value[active], listed[active], done[active] = (np.take_along_axis(v, top, 1) for v in (every, names, over))
        done[active] |= value[active] == -np.inf
        active = active[(~done[active]).any(1)]
    spread = np.zeros((q, n), bool)
    while True:  # the frontier: found within range (with slack) and not gone through yet
        who, node = np.nonzero((score >= radius - SLACK) & ~spread)
        if not len(who):
            return score >= radius - 1e-4
        spread[who, node] = True
        for low in range(0, len(who), 20_000):
            w, nb = who[low : low + 20_000], graph[node[low : low + 20_000]]
            fresh = ~seen[w[:, None], nb]
            i, j = np.nonzero(fresh)
            w, nb = w[i], nb[i, j]
            seen[w, nb] = True
            score[w, nb] = np.einsum("rd,rd->r", x[nb], queries[w])


def links(vectors: DataFrame, similarity: float = SIMILARITY, overlap: int = OVERLAP, cluster_rows: int = CLUSTER_ROWS) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of usable rows, and (key, class_id, n_links) for each class of equal vectors of a label."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.filter(usable()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = settle(rows.withColumn("key", F.xxhash64("label", "embedding")))
    classes = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("ident"), F.first("label").alias("label"), F.first("embedding").alias("embedding")))
    shared = spark.sparkContext.broadcast(centroids(classes, cluster_rows=cluster_rows))  # at most MOST_CENTROIDS

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            t["clusters"] = None
            for label, part in t.groupby("label"):
                c = shared.value.get(label)
                if c is None:  # too few rows for the sample: one cluster
                    t.loc[part.index, "clusters"] = pd.Series([[0]] * len(part), part.index)
                    continue
                top = np.argsort(-(_unit(list(part.embedding)) @ c.T), 1, kind="stable")[:, :overlap]
                t.loc[part.index, "clusters"] = pd.Series([sorted(map(int, x)) for x in top], part.index)
            yield t

    kind = classes.schema["label"].dataType.simpleString()
    placed = settle(classes.select("key", "copies", "label", "embedding").mapInPandas(assign, f"key bigint, copies bigint, label {kind}, embedding array<double>, clusters array<int>"))
    spread = placed.select("*", F.explode("clusters").alias("cluster"))
    size = spread.groupBy("label", "cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    members = settle(spread.join(size, ["label", "cluster"]).withColumn("block", F.struct("label", "cluster", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("part"))))

    def build(t: pa.Table) -> pa.Table:
        key = t.column("key").to_numpy()
        return pa.table({"key": key, "next": pa.array(list(key[prune(_unit(t.column("embedding").to_pylist()))]), pa.list_(pa.int64()))})

    lists = members.select("block", "key", "embedding").groupBy("block").applyInArrow(build, "key bigint, next array<bigint>")
    united = lists.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))  # as many lists as blocks of a vector
    own = members.select("key", "copies", "embedding", "clusters", "block").join(united, "key")
    parts = size.select("label", "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("i"), "blocks")
    parts = parts.select("label", "cluster", "i", F.explode(F.sequence(F.col("i"), F.col("blocks").cast("int") - 1)).alias("j"))
    block = lambda c: F.struct("label", "cluster", F.col(c).alias("part"))
    pairs = parts.select(block("i").alias("a"), block("j").alias("b"))

    def find(t: pa.Table) -> pa.Table:
        key, copies, side = (t.column(c).to_numpy() for c in ("key", "copies", "side"))
        cluster = t.column("pair")[0].as_py()["a"]["cluster"]
        x = _unit(t.column("embedding").to_pylist())
        near = np.zeros((len(key), len(key)), bool)
        for s in (0, 1):
            nodes = np.flatnonzero(side == s)
            asking = np.flatnonzero(side != s) if (side == 1).any() else nodes
            if not len(nodes) or not len(asking):
                continue
            at = {int(k): i for i, k in enumerate(key[nodes])}
            lists_ = [[at[k] for k in t.column("next")[int(i)].as_py() if k in at] for i in nodes]
            near[np.ix_(asking, nodes)] |= search(x[nodes].astype(np.float32), with_reverse(lists_), x[asking].astype(np.float32), similarity, own=asking is nodes)
        near |= near.T
        np.fill_diagonal(near, False)
        a, b = np.nonzero(near)
        # Verified in double precision. A pair that meets in several clusters counts in the lowest.
        both = np.array(t.column("clusters").to_pylist())
        lower = (both[a][:, :, None] == both[b][:, None, :]) & (both[a] < cluster)[:, :, None]
        fine = np.einsum("rd,rd->r", x[a], x[b]) >= similarity
        root = forest(a[fine], b[fine], len(key))  # all pairs found join groups
        fine, linked = fine & ~lower.any((1, 2)), np.unique(a[fine])
        sums = np.bincount(a[fine], copies[b[fine]].astype(np.float64), len(key)).astype(np.int64)
        own_ = linked
        return pa.table({"u": key[own_], "v": key[root[own_]], "links": sums[own_]})

    found = paired_rows(own, pairs).groupBy("pair").applyInArrow(find, "u bigint, v bigint, links bigint")
    return keyed.select("vec_id", "key"), summarize_links(found, classes.select("key", "copies", "ident"))


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, overlap: int = OVERLAP, cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """One row for each row of vectors (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and their cosine is at least ``similarity``; equal vectors
    always do. Rows that usable() leaves out link with nothing and are their own component. Vectors
    of a label must have one length. Repeated rows count as equal vectors.
    """
    keyed, summary = links(vectors, similarity, overlap, cluster_rows)
    known = keyed.join(summary, "key").select("vec_id", "n_links", "class_id")
    others = vectors.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("class_id"))
    out = known.unionByName(others)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("class_id").cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, similarity: float = SIMILARITY, most: int = 200) -> float:
    """The share of true links that result has for at most ``most`` vectors (chosen by hash), each compared with all."""
    rows = vectors.filter(usable()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = rows.orderBy(F.xxhash64("vec_id")).limit(most).collect()
    shared = vectors.sparkSession.sparkContext.broadcast([(r.vec_id, r.label, np.array(r.embedding)) for r in asked])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            x = _unit(list(t.embedding))
            for vec, label, e in shared.value:
                n = int(((x @ (e / np.linalg.norm(e)) >= similarity) & (t.label == label) & (t.vec_id != vec)).sum())
                if n:
                    yield pd.DataFrame({"vec_id": [vec], "n": [n]})

    true = rows.mapInPandas(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    a, b = true.join(result, "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return 1.0 if not a else b / a
