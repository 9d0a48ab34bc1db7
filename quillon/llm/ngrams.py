"""N-gram Jaccard join: MinHash banding, then exact Jaccard on whole sets of word shingles.

Texts with equal shingle sets form a class. Each class's MinHash signature is cut into
bands; classes that share a band's hash are candidates. Candidates come together in
blocks of bounded size, a pair of blocks to a task, which compares all its sets at once;
it returns a count for each class and a spanning forest, never the pairs. So a group of
thousands of near copies costs a few matrix products, and no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, paired_rows, settle, small_batches, summarize_links

WORDS = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.99
MOST_HASHES = 64
#: Bounds of a block: classes, and shingles of all its sets.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 400_000
KNOWN_WORDS = 500_000
#: Candidates are broadcast to fetch their texts up to so many rows (of under 100 bytes); more are shuffled.
BROADCAST_ROWS = 300_000


def choose_bands(similarity: float = SIMILARITY, recall: float = TARGET_RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows a band for which the bands that reach the recall fit into most_hashes."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        bands = 1
        while 1 - (1 - similarity**rows) ** bands < recall and bands * rows <= most_hashes:
            bands += 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


class Shingler:
    """Sorted sets of 64-bit hashes of word n-grams."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}
        self.odd = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(words)], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        """Of lower-cased words between white space. A text of fewer words than n has one shingle of all; one without words has none."""
        split = (text or "").lower().split()
        if not split:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(split):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
        n = min(self.words, len(split))
        mixed = np.full(len(split) - n + 1, n, np.uint64)
        for i in range(n):
            x = hashes[i : len(split) - n + 1 + i] * self.odd[i]
            mixed = (mixed ^ x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(mixed ^ (mixed >> np.uint64(32)))


def signatures(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """(doc_id, row, key, n, bands): the row's own hash, its shingle set's hash and size, and its band hashes. No words: n is 0."""
    small_batches(docs.sparkSession)
    random = np.random.default_rng(1)
    a, b = random.integers(1 << 63, size=(2, bands * rows, 1), dtype=np.uint64)
    a |= np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                keys.append(int(xxhash.xxh3_64_intdigest(own.tobytes())) - (1 << 63))
                if not len(own):
                    hashes.append([])
                    continue
                low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(own), 4096):
                    low = np.minimum(low, (own[at : at + 4096] * a + b).min(1))
                hashes.append([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in low.reshape(bands, rows)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "row", "key", "n", "bands"])

    rows_ = docs.select("doc_id", row_key().alias("row"), "text")
    return rows_.mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row bigint, key bigint, n int, bands array<bigint>")


def row_key():
    """Tells rows apart by id and text."""
    return F.xxhash64("doc_id", "text")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share: common elements by matrix products, rare ones pair by pair."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    starts = np.cumsum(count) - count
    often = np.flatnonzero(count >= 32)
    for at in range(0, len(often), 4096):
        some = often[at : at + 4096]
        matrix = np.zeros((n, len(some)), np.float32)
        for column, v in enumerate(some):
            matrix[of[order[starts[v] : starts[v] + count[v]]], column] = 1
        out += matrix @ matrix.T
    flat = out.reshape(-1)
    for c in range(2, 32):
        some = np.flatnonzero(count == c)
        if len(some):
            members = of[order[starts[some][:, None] + np.arange(c)]]
            i, j = np.triu_indices(c, 1)
            cells = np.concatenate([members[:, i] * n + members[:, j], members[:, j] * n + members[:, i]]).ravel()
            flat += np.bincount(cells, minlength=n * n).astype(np.float32)
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place reachable from each of n places by links (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """The signatures' rows (settled), and (key, class_id, n_links) for each class of equal sets."""
    bands, rows = choose_bands(similarity, recall)
    signed = settle(signatures(docs, bands, rows, words))
    classes = signed.filter("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("ident"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = settle(classes)
    in_band = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    full = in_band.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("low")).filter("m > 1").drop("m")
    candidates = settle(in_band.join(full, ["band", "hash"]))
    # A class goes into a block with those that share its lowest bucket, so near copies gather in few blocks.
    label = candidates.groupBy("key").agg(F.min("low").alias("label")).join(classes.select("key", "row", "copies", "n"), "key")
    size = label.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = settle(label.join(size, "label").select("key", "row", "copies", F.struct("label", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("part")).alias("block")))
    pairs = block_pairs(candidates.join(members.select("key", "block"), "key").select("band", "hash", "block").distinct(), ["band", "hash"])
    few = members.count() <= BROADCAST_ROWS
    texts = docs.select(row_key().alias("row"), "text").join(F.broadcast(members) if few else members, "row").dropDuplicates(["row"])  # a row that comes a million times is compared once

    def verify(t: pa.Table) -> pa.Table:
        shingles = Shingler(words)
        key, copies, side = (t.column(c).to_numpy() for c in ("key", "copies", "side"))
        sets = [shingles(x.as_py()) for x in t.column("text")]
        size_ = np.array([len(s) for s in sets], np.float64)
        near = intersections(sets) * (1 + similarity) >= similarity * (size_[:, None] + size_) - 1e-6
        np.fill_diagonal(near, False)
        if (side == 1).any():
            near &= side[:, None] != side
        a, b = np.nonzero(near)
        root = forest(a, b, len(key))
        own = np.flatnonzero(near.any(1))
        return pa.table({"u": key[own], "v": key[root[own]], "links": (near[own] @ copies.astype(np.float64)).astype(np.int64)})

    found = paired_rows(texts, pairs).groupBy("pair").applyInArrow(verify, "u bigint, v bigint, links bigint")
    return signed, summarize_links(found, classes.select("key", "copies", "ident"))


def join(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = TARGET_RECALL) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id, n_links.

    class_id: the smallest doc_id of its connected group; n_links: the other rows whose
    Jaccard similarity with it is at least ``similarity``, copies included. A text
    without words (or null) links with nothing and is its own class. Rows with a
    null id take part; repeated rows count as copies.
    """
    signed, summary = links(docs, similarity, words, recall)
    out = signed.join(summary, "key", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """docs without those that a connected group has besides its first (by id, a null one last, then by a hash of the row); same columns.

    Rows repeated with id and text count as copies, without words too.
    """
    signed, summary = links(docs, similarity, words)
    rows = signed.filter("n > 0").select("key", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("r")).join(summary.select("key", "component"), "key")
    first = rows.groupBy("component").agg(F.min("r").alias("r")).select("r.row")
    kept = first.unionByName(signed.filter("n = 0").select("row")).distinct().withColumnRenamed("row", "__row")
    got = docs.withColumn("__row", row_key()).join(kept, "__row").dropDuplicates(["__row"])
    return got.select(*[F.col(f"`{c}`") for c in docs.columns])
