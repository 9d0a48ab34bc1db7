"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks. While a set of sources is active (a phase), source i of
integer weight w_i out of P = sum of the weights gets its k-th block (k = 1, 2, ...)
a release time floor((k-1) P / w_i) and a deadline ceil(k P / w_i); a slot takes one
block, and the released block of earliest deadline goes first. Every block is then
placed within its window, so at any slot each source is less than one block from its
share. When a source has no more rows its phase ends, and the others go on by their
weights among themselves. No row is dropped or repeated.

The schedule repeats after P slots, so the driver solves one period a phase; rows
find their slots by arithmetic. The ALONE sources with the most rows are scheduled alone
and any others in groups: a group gets its members' weights
together, and its own blocks are ordered by deadline on executors.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import drop_clashing, number_rows, settle

BLOCK_ROWS = 64
#: The sum that default weights are scaled to, the length of a period.
WEIGHT_UNITS = 1000
#: Default weights go with a source's rows to this power, between even (0) and as they are (1).
TEMPERATURE = 0.5
#: The ALONE largest sources are scheduled alone, any others in GROUPS groups: the schedule is made on the driver.
ALONE, GROUPS = 128, 128
#: The sources' sizes are broadcast up to so many; more are shuffled.
MOST_SOURCES = 2000


@dataclass(frozen=True)
class Phase:
    """Slots of one set of active sources."""

    start: int  # the position of its first row
    period: int
    slots: dict[str, list[int]]  # of each source in a period
    first: dict[str, int]  # the block of each source that comes first here
    last: dict[str, int]  # and the first one that doesn't come here


def period_slots(weights: dict[str, int], left: dict[str, int] | None = None) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(weights) slots, by earliest deadline among released blocks.

    left: the blocks that each source still has; the slots end with the first source to have had its last one.
    """
    period = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]  # release, source, block
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    slots: dict[str, list[int]] = {s: [] for s in weights}
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // weights[s]), s, k))
        deadline, s, k = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        slots[s].append(t)
        if left and len(slots[s]) == left[s]:
            break
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * period // weights[s], s, k + 1))
    return slots


def schedule(rows: dict[str, int], weights: dict[str, int], block_rows: int) -> list[Phase]:
    """The phases for sources of so many rows. Sources of weight 0 come last, evenly."""
    blocks = {s: -(-n // block_rows) for s, n in rows.items() if n > 0}
    done = dict.fromkeys(blocks, 0)
    phases, start = [], 0
    while left := [s for s in blocks if done[s] < blocks[s]]:
        active = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1)
        slots, period = period_slots(active, {s: blocks[s] - done[s] for s in active}), sum(active.values())
        end_of = {}
        for s in active:
            k = blocks[s] - done[s] - 1
            if k % active[s] < len(slots[s]):  # else the period was broken off before
                end_of[s] = k // active[s] * period + slots[s][k % active[s]] + 1
        over = min(end_of, key=end_of.get)
        length = end_of[over]
        first = {s: done[s] for s in active}
        for s in active:
            done[s] += length // period * active[s] + sum(t < length % period for t in slots[s])
        phases.append(Phase(start, period, slots, first, {s: done[s] for s in active}))
        start += length * block_rows - (blocks[over] * block_rows - rows[over])
    return phases


def grouped_sources(sizes: DataFrame, weights: dict[str, int] | None, temperature: float = TEMPERATURE) -> DataFrame:
    """(mix_source, n, w, __unit): what each source is scheduled as: itself ("=..." or "-"), or a group ("+..." or, of weight 0, "0...")."""
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    elif weights:
        named = [("-" if s is None else "=" + s, float(w)) for s, w in weights.items()]
        sizes = sizes.join(sizes.sparkSession.createDataFrame(named, "mix_source string, w double"), "mix_source", "left").fillna(1.0, ["w"])
    else:
        sizes = sizes.withColumn("w", F.lit(1.0))
    largest = sizes.orderBy(F.desc("n"), "mix_source").limit(ALONE).select("mix_source", F.lit(True).alias("__alone"))
    group = F.concat(F.when(F.col("w") > 0, "+").otherwise("0"), F.pmod(F.xxhash64("mix_source"), F.lit(GROUPS)).cast("string"))
    return settle(sizes.join(F.broadcast(largest), "mix_source", "left").select("mix_source", "n", "w", F.when(F.col("__alone"), F.col("mix_source")).otherwise(group).alias("__unit")))


def default_weights(units: dict[str, float], period: int = WEIGHT_UNITS) -> dict[str, int]:
    """Integers of about ``period`` together, in proportion, each at least 1."""
    total = sum(units.values())
    return {u: max(1, round(period * w / total)) for u, w in units.items()}


def ranked_in_groups(ranked: DataFrame, sizes: DataFrame, block_rows: int) -> DataFrame:
    """ranked with ``__unit``, and ``__rank`` in it: blocks of a group's sources by deadline, (k + 1) / w (evenly, if w is 0)."""
    members = sizes.filter(F.col("mix_source") != F.col("__unit"))
    blocks = members.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_rows))))
    due = (F.col("__k") + 1) / F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(1.0))
    m = F.least(F.lit(block_rows), F.col("n") - F.col("__k") * block_rows)
    before = F.sum(m).over(W.partitionBy("__unit").orderBy(due, F.xxhash64("mix_source", "__k"), "mix_source", "__k").rowsBetween(W.unboundedPreceding, W.currentRow)) - m
    places = blocks.select(F.col("mix_source").alias("__s"), "__k", "__unit", before.alias("__offset"))
    ranked = ranked.withColumn("__k", F.floor(F.col("__rank") / block_rows))
    met = ranked.join(places.withColumnRenamed("__k", "__at"), (F.col("mix_source") == F.col("__s")) & (F.col("__k") == F.col("__at")), "left")
    met = met.withColumn("__rank", F.when(F.col("__unit").isNull(), F.col("__rank")).otherwise(F.col("__offset") + F.col("__rank") % block_rows))
    return met.withColumn("__unit", F.coalesce("__unit", "mix_source")).drop("__s", "__at", "__k", "__offset")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, source: str = "source", ident: tuple[str, ...] = ("doc_id",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with ``position`` (0, 1, 2, ... over all rows, gapless), ``block`` (the place of its block in the schedule) and ``mix_source``.

    A null source is one of its own. weights: by source, integers >= 0; a source
    that isn't named gets 1; None: default_weights. ident: columns that tell rows
    of a source apart (repeated rows are interchangeable). Columns of docs with an
    output's name or beginning with ``__`` give way. An empty table gives an empty one.
    Of over ALONE sources, a block of a group may hold rows of several of its sources.
    """
    spark = docs.sparkSession
    docs = drop_clashing(docs, ["position", "block", "mix_source"])
    docs = docs.withColumn("mix_source", F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source).cast("string"))))
    sizes = grouped_sources(docs.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")), weights)
    # At most ALONE + 2 * GROUPS rows; in order, as sums of rounded numbers are by it.
    units = sizes.groupBy("__unit").agg(F.sum("n").alias("n"), F.sum(F.col("w").cast("decimal(38,9)")).alias("w"), F.count(F.lit(1)).alias("sources")).orderBy("__unit").collect()
    rows = {r[0]: r.n for r in units}
    own = default_weights({r[0]: float(r.w) for r in units}) if weights is None else {r[0]: int(r.w) for r in units}
    table, phase_slots = [], []
    slots_before = 0
    for p, x in enumerate(schedule(rows, own, block_rows)):
        for s in x.slots:
            if x.last[s] > x.first[s]:
                table.append((s, x.first[s], x.last[s], x.period, x.slots[s], x.start, slots_before))
        phase_slots.append(sum(x.last[s] - x.first[s] for s in x.slots))
        slots_before += phase_slots[-1]
    plan = spark.createDataFrame(table, "mix_source string, __first long, __last long, __period long, __slots array<long>, __start long, __before long")
    few = sum(r.sources for r in units) <= MOST_SOURCES
    ranked = number_rows(docs, "mix_source", list(ident), F.broadcast(sizes) if few else sizes, "__rank")
    if all(r[0][0] in "=-" for r in units):
        ranked = ranked.withColumn("__unit", F.col("mix_source"))
    else:
        ranked = ranked_in_groups(ranked, sizes, block_rows)
    ranked = ranked.withColumn("__b", F.floor(F.col("__rank") / block_rows))
    # plan: a row for each source and phase, checked above; a source's phases don't overlap, so each row meets one.
    met = ranked.join(F.broadcast(plan.withColumnRenamed("mix_source", "__s")), (F.col("__unit") == F.col("__s")) & (F.col("__b") >= F.col("__first")) & (F.col("__b") < F.col("__last")))
    k, w = F.col("__b") - F.col("__first"), F.size("__slots")
    slot = F.floor(k / w) * F.col("__period") + F.get("__slots", (k % w).cast("int"))
    met = met.withColumn("position", (F.col("__start") + slot * block_rows + F.col("__rank") % block_rows).cast("long"))
    met = met.withColumn("block", (F.col("__before") + slot).cast("long"))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix_source"], "mix_source", "position", "block")
