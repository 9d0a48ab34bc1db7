"""Resharding by minimum-cost flow.

Rows of the old shards form blocks by size class, cut at the size of the row that has to be the last to leave its shard
(rows of just that size are a block of their own). Flow goes from the blocks through
the new shards, whose capacities are row counts at most one apart; staying costs
nothing and moving a row costs its block's mean bytes. The cheapest flow says how many
rows of each block go where, lighter rows leaving first; rows find their shard by their number in their block, and
the files of shards that give or take rows are written anew. As a shard's blocks either leave whole, stay whole, or are of
one size, no other rows would move fewer bytes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import drop_clashing, number_rows, settle

OLD_SHARDS = 12
NEW_SHARDS = 16
#: Size classes of rows for each doubling of their bytes.
CLASSES_PER_DOUBLING = 2


class Flow:
    """Minimum-cost flow by successive shortest paths, with potentials."""

    def __init__(self, nodes: int):
        self.arcs: list[list] = []  # to, capacity left, cost
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, u: int, v: int, capacity: int, cost: float) -> int:
        self.out[u].append(len(self.arcs))
        self.arcs.append([v, capacity, cost])
        self.out[v].append(len(self.arcs))
        self.arcs.append([u, 0, -cost])
        return len(self.arcs) - 2

    def through(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def run(self, source: int, sink: int) -> int:
        n, sent = len(self.out), 0
        height = [0.0] * n
        while True:
            dist, via = [float("inf")] * n, [-1] * n
            dist[source], heap = 0.0, [(0.0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for a in self.out[u]:
                    v, capacity, cost = self.arcs[a]
                    if capacity and (e := d + max(0.0, cost + height[u] - height[v])) < dist[v] - 1e-9:
                        dist[v], via[v] = e, a
                        heapq.heappush(heap, (e, v))
            if via[sink] < 0:
                return sent
            for v in range(n):
                height[v] += min(dist[v], dist[sink])
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.arcs[via[v] ^ 1][0]
            most = min(self.arcs[a][1] for a in path)
            for a in path:
                self.arcs[a][1] -= most
                self.arcs[a ^ 1][1] += most
            sent += most


def solve_transfers(blocks: dict[tuple[int, int], tuple[int, int]], new_shards: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For blocks (old shard, class) -> (rows, bytes): where their rows go, as (new shard, rows), fewest bytes moved.

    New shards end with row counts at most one apart. Old shard i is kept as new
    shard i where there is one.
    """
    keys = sorted(blocks)
    total = sum(n for n, _ in blocks.values())
    least, more = divmod(total, new_shards)
    source, sink, hub, extra = range(4)
    shard = lambda j: 4 + j
    flow = Flow(4 + new_shards + len(keys))
    stay, leave = {}, {}
    for at, (key, (n, size)) in enumerate((k, blocks[k]) for k in keys):
        node = 4 + new_shards + at
        flow.add(source, node, n, 0)
        if key[0] < new_shards:
            stay[key] = flow.add(node, shard(key[0]), n, 0)
        leave[key] = flow.add(node, hub, n, size / n)
    arrive = [flow.add(hub, shard(j), total, 0) for j in range(new_shards)]
    for j in range(new_shards):
        flow.add(shard(j), sink, least, 0)
        flow.add(shard(j), extra, 1, 0)
    flow.add(extra, sink, more, 0)
    if flow.run(source, sink) != total:
        raise AssertionError("not all rows found a shard")
    room = [[j, flow.through(a)] for j, a in enumerate(arrive)]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for key in keys:
        parts = []
        going = flow.through(leave[key])
        while going:
            j, free = room[-1]
            if take := min(going, free):
                parts.append((j, take))
                going -= take
                room[-1][1] -= take
            if not room[-1][1]:
                room.pop()
        if key in stay:
            parts.append((key[0], flow.through(stay[key])))
        out[key] = [(j, n) for j, n in parts if n]
    return out


def reshard(rows: DataFrame, old: Column, size: Column, ident: tuple[str, ...], new_shards: int = NEW_SHARDS) -> DataFrame:
    """rows with ``old_shard``, ``shard`` (0 to new_shards - 1, row counts at most one apart) and ``slot`` (0, 1, ... in a shard).

    old: each row's old shard, an integer >= 0 (not null); size: its bytes (null: 0).
    The bytes moved are the fewest.
    Columns of rows named like outputs or beginning with ``__`` give way; repeated
    rows are rows of their own; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    rows = drop_clashing(rows.withColumn("__old", old.cast("int")).withColumn("__size", F.coalesce(size, F.lit(0)).cast("long")), ["old_shard", "shard", "slot"])
    per_size = settle(rows.groupBy("__old", "__size").agg(F.count(F.lit(1)).alias("n")))
    upto = per_size.withColumn("__upto", F.sum("n").over(W.partitionBy("__old").orderBy("__size")))
    counts = {r[0]: r[1] for r in per_size.groupBy("__old").agg(F.sum("n")).collect()}  # a row for each old shard
    least = sum(counts.values()) // new_shards
    # If a shard ends with the least rows, rows up to this size leave it.
    over = {i: n - least for i, n in counts.items() if n > least and i < new_shards}
    last = {}
    if over:
        wanted = spark.createDataFrame(sorted(over.items()), "__old int, __over long")
        last = {r[0]: r[1] for r in upto.join(F.broadcast(wanted), "__old").filter("__upto >= __over and __upto - n < __over").select("__old", "__size").collect()}
    at = spark.createDataFrame(sorted(last.items()), "__old int, __last long")
    rows = rows.join(F.broadcast(at), "__old", "left")
    side = F.coalesce(F.signum(F.col("__size") - F.col("__last")), F.lit(0)).cast("int") + 1
    rows = rows.withColumn("__class", F.floor(F.log2(F.col("__size") + 1) * CLASSES_PER_DOUBLING).cast("int") * 3 + side).drop("__last")
    rows = rows.withColumn("__block", F.concat_ws(":", "__old", "__class"))
    found = rows.groupBy("__old", "__class").agg(F.count(F.lit(1)), F.sum("__size")).collect()  # at most 130 classes a shard
    blocks = {(r[0], r[1]): (r[2], r[3]) for r in found}
    moves = solve_transfers(blocks, new_shards) if blocks else {}
    cuts, per_shard = [], [0] * new_shards
    for (i, c), parts in moves.items():
        low = 0
        for j, n in parts:
            cuts.append((f"{i}:{c}", low, low + n, j))
            per_shard[j] += n
            low += n
    # Rows are numbered by size, so that the lightest of a block leave.
    own = rows.groupBy("__block", "__size").agg(F.count(F.lit(1)).alias("n"))
    own = settle(own.select(F.concat_ws(":", "__block", "__size").alias("__kind"), "n", (F.sum("n").over(W.partitionBy("__block").orderBy("__size")) - F.col("n")).alias("__from")))
    ranked = number_rows(rows.withColumn("__kind", F.concat_ws(":", "__block", "__size")), "__kind", list(ident), own.select("__kind", "n"), "__rank")
    ranked = ranked.join(own.drop("n"), "__kind").withColumn("__rank", F.col("__from") + F.col("__rank")).drop("__kind", "__from")
    plan = spark.createDataFrame(cuts, "__b string, __low long, __high long, shard int")
    placed = ranked.join(F.broadcast(plan), (F.col("__block") == F.col("__b")) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high")))
    placed = placed.drop("__b", "__low", "__high", "__rank", "__block", "__class", "__size")
    ends = spark.createDataFrame(list(enumerate(per_shard)), "shard int, n long")
    out = number_rows(placed, "shard", list(ident), F.broadcast(ends), "slot")
    return out.withColumnRenamed("__old", "old_shard").select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("__")], "old_shard", "shard", "slot")


def rewrite_affected(resharded: DataFrame, out: str) -> list[int]:
    """Writes the files of the shards that give or take rows to ``out``/shard=j; returns their numbers.

    resharded: what reshard() gave, with all the columns to write. Other shards'
    files stay as they are.
    """
    settled = settle(resharded)
    moved = settled.filter("old_shard <> shard")
    touched = {r[0] for side in ("old_shard", "shard") for r in moved.select(side).distinct().collect()}
    settled.filter(F.col("shard").isin(sorted(touched))).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(out)
    return sorted(touched)


def old_layout(docs: DataFrame, old_shards: int = OLD_SHARDS) -> Column:
    """The layout before: documents kept by source."""
    return F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(old_shards))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), old_layout(docs).cast("int").alias("__layout"))
    rows = settle(rows)
    out = reshard(rows, F.col("__layout"), F.col("size"), ("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
