"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's documents are dealt by hash over its shards and stand in a shard in seeded order, so their words form one
stream that is cut into blocks of equal words: BLOCK, or fewer where the least target would have under LEAST_BLOCKS of
them, down to 1. The target of all sources together is apportioned to sources, and each source's to its shards, in whole
blocks: the next block goes to the highest quotient target / (2 * quota + 1). A shard takes all its blocks as often as
its quota allows and the remaining blocks by seeded systematic choice over the seeded order, so what a document gives is
arithmetic on its place in the stream: no block becomes a row, and reruns agree.

The driver holds one number for each source and shard; shards are at most SHARDS and one for each source.

Defined cases: null text has size 0, gives 0; null is a source, last in order; sources that weigh nothing or are empty
get 0; rows that repeat are as many documents; no documents give no rows. An output column replaces one of its name.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import settle

#: Words in a block, at most; blocks that the least target should have; words that a shard should have, at least; shards
#: at most, besides one for each source.
BLOCK, LEAST_BLOCKS, SHARD_WORDS, SHARDS = 64, 32, 200_000, 20_000
#: Sources that the driver may be given; weights are by source, so whoever states them has a list of that length.
MOST_SOURCES = 200_000
SEED = 20_240_117
MOST_TIMES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.0, most_times: float = MOST_TIMES) -> list[float]:
    """What each source should give: share of all, by weight; no more than most_times its size, the excess shared anew."""
    rest, capped = share * sum(sizes), [False] * len(sizes)
    while True:
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        left = rest - sum(most_times * s for s, c in zip(sizes, capped, strict=True) if c)
        out = [most_times * s if c else left * w / weight if weight else 0.0 for s, w, c in zip(sizes, weights, capped, strict=True)]
        above = [not c and x > most_times * s for x, s, c in zip(out, sizes, capped, strict=True)]
        if not any(above):
            return out
        capped = [a or c for a, c in zip(above, capped, strict=True)]


def apportion(wanted: dict[Hashable, float], seats: int, most: dict[Hashable, int]) -> dict[Hashable, int]:
    """Whole quotas that sum to seats (or to all that most allows), each seat to the highest quotient wanted / (2 * quota
    + 1); of equal ones to the first key. All quotients down to a divisor found by bisection are given out at once, and
    the few seats that are left one by one."""
    quota = dict.fromkeys(wanted, 0)
    total = sum(wanted.values())
    if total <= 0 or seats <= 0:
        return quota

    def down_to(divisor: float) -> dict[Hashable, int]:
        return {k: min(most[k], int(w / divisor + 0.5)) for k, w in wanted.items()}

    low, high = min((w for w in wanted.values() if w > 0)) / (4 * seats + 4), 2 * total + 1
    for _ in range(100):
        middle = (low * high) ** 0.5
        if sum((got := down_to(middle)).values()) <= seats:
            quota, high = got, middle
        else:
            low = middle
    order = {k: i for i, k in enumerate(wanted)}
    heap = [(-w / (2 * quota[k] + 1), order[k], k) for k, w in wanted.items() if w > 0 and quota[k] < most[k]]
    heapq.heapify(heap)
    left = seats - sum(quota.values())
    while left > 0 and heap:
        _, i, k = heapq.heappop(heap)
        quota[k] += 1
        left -= 1
        if quota[k] < most[k]:
            heapq.heappush(heap, (-wanted[k] / (2 * quota[k] + 1), i, k))
    return quota


def shares(source_sizes: dict[str | None, int], weights: Sequence[float], share: float) -> dict[str | None, tuple[int, float]]:
    """Source: (size, target). Weights go round the sources in order of code points, null last."""
    names = sorted(source_sizes, key=lambda s: (s is None, s or ""))
    sizes = [source_sizes[s] for s in names]
    return dict(zip(names, zip(sizes, targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share), strict=True), strict=True))


def block_words(wanted: Sequence[float]) -> int:
    """Words of a block, by the targets."""
    return int(min(BLOCK, max(1, min((t for t in wanted if t > 0), default=BLOCK) // LEAST_BLOCKS)))


_PLAN = "source string, shard int, source_size long, target double, n_blocks long, quota long, shift double"


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, seed: int = SEED, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """id_col, source, size, source_size, target (the source's) and taken (words that the mix takes of the document, repeats
    counted) for each row of docs."""
    spark = docs.sparkSession
    sized = settle(docs.select(F.col(id_col), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"))
    sizes = {r["source"]: r["size"] for r in by_source.limit(MOST_SOURCES + 1).toLocalIterator()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"weights are stated by source, and there are more than {MOST_SOURCES}")
    plan = shares(sizes, weights, share)
    words = max(SHARD_WORDS, -(-sum(sizes.values()) // SHARDS))
    counts = spark.createDataFrame([(s, -(-n // words) or 1) for s, n in sizes.items()], "source string, shards int")
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    dealt = sized.join(F.broadcast(counts), sized["source"].eqNullSafe(counts["source"])).select(sized["*"], F.pmod(key, F.col("shards").cast("long")).cast("int").alias("shard"), F.xxhash64(F.lit(seed + 1), F.col(id_col)).alias("place"))
    shards: dict[str | None, dict[int, int]] = {}
    for r in dealt.groupBy("source", "shard").agg(F.sum("size").alias("size")).toLocalIterator():
        shards.setdefault(r["source"], {})[r["shard"]] = r["size"]
    block = block_words([t for _, t in plan.values()])
    rows = list(_quotas(plan, shards, seed, block))
    placed = spark.createDataFrame(rows, _PLAN)
    joined = dealt.join(F.broadcast(placed), dealt["source"].eqNullSafe(placed["source"]) & (dealt["shard"] == placed["shard"])).select(
        dealt["*"], *[placed[c] for c in ("source_size", "target", "n_blocks", "quota", "shift")]
    )
    order = Window.partitionBy("source", "shard").orderBy("place", id_col, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(order)
    return joined.withColumn("end", end).withColumn("taken", taken(F.col("end") - F.col("size"), F.col("end"), block)).select(id_col, "source", "size", "source_size", "target", "taken")


def _quotas(plan: dict, shards: dict, seed: int, block: int):
    """A row of _PLAN for each shard."""
    blocks = {s: {k: -(-n // block) for k, n in own.items()} for s, own in shards.items()}
    most = {s: MOST_TIMES * sum(own.values()) for s, own in blocks.items()}
    total = round(sum(t for _, t in plan.values()) / block)
    quotas = apportion({s: plan[s][1] for s in plan}, total, most)
    for s, (size, target) in plan.items():
        own = {k: shards[s][k] for k in sorted(shards[s])}
        got = apportion({k: float(n) for k, n in own.items()}, quotas[s], {k: MOST_TIMES * blocks[s][k] for k in own})
        for k in own:
            yield s, k, size, float(target), blocks[s][k], got[k], ((seed * 2654435761 + k * 40503 + len(s or "")) % 1009 + 0.5) / 1010


def taken(start: Column, end: Column, size: int) -> Column:
    """Words of [start, end) that the shard's quota takes, in blocks of size words. Of n blocks, quota // n times all and r more: those blocks b
    at which floor((b + 1) * r / n + shift) is past floor(b * r / n + shift), r in all."""
    n, quota = F.greatest(F.col("n_blocks"), F.lit(1)), F.col("quota")
    times, r = F.floor(quota / n), quota % n

    def chosen_before(b: Column) -> Column:
        return F.floor(b * r / n + F.col("shift")).cast("long")

    def within(block: Column, words: Column) -> Column:
        return words * (chosen_before(block + 1) - chosen_before(block))

    first, last = F.floor(start / size), F.floor((end - 1) / size)
    same = within(first, end - start)
    more = within(first, (first + 1) * size - start) + within(last, end - last * size) + size * (chosen_before(last) - chosen_before(first + 1))
    return F.when(end == start, F.lit(0)).otherwise(times * (end - start) + F.when(first == last, same).otherwise(more)).cast("long")


def copies(taken_words: Column, size: Column) -> Column:
    """How often a document that stays whole stands in the mix: what was taken of it, in documents, rounded half up."""
    return F.when(size == 0, F.lit(0)).otherwise(F.floor(taken_words / size + 0.5)).cast("int")
