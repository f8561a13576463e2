"""Filling containers of fixed capacity with texts, by shortest-pack-first over the length histogram.

Only the histogram of lengths (at most ``capacity`` rows) comes to the driver.  Lengths
are placed longest first; a length goes into the open packing patterns with the most
room, whole counts at a time, so a pattern stands for many equal containers (Krell et
al., 2021).  Each slot of a finished pattern takes a range of the ranks of its length;
texts are joined to their slot by (length, rank).

Ranks are counted over a hash bucket of the id first and shifted by the buckets'
prefix sums, so a length that a third of all texts share isn't ranked by one task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions.tokens import count_tokens
from garimpo.plans.tables import cut, small

BUCKETS, BLOCK = 64, 1024


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of the packing patterns; counts are containers."""
    room: list[tuple[int, int]] = []  # heap of (-room, number of the pattern)
    counts: list[int] = []
    lengths: list[tuple] = []  # linked lists: (length, times, rest)

    def add(count: int, chain: tuple, left: int) -> None:
        counts.append(count)
        lengths.append(chain)
        if left > 0:
            heapq.heappush(room, (-left, len(counts) - 1))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo > 0:
            if room and -room[0][0] >= length:
                left, at = -room[0][0], room[0][1]
                heapq.heappop(room)
                used = min(todo, counts[at])
                if used < counts[at]:
                    counts[at] -= used
                    heapq.heappush(room, (-left, at))
                else:
                    counts[at] = 0
                add(used, (length, lengths[at]), left - length)
                todo -= used
            else:
                # no more new containers than this length needs if it fills them alone
                new = -(-todo // (capacity // length))
                add(new, (length, ()), capacity - length)
                todo -= new
    out = []
    for count, chain in zip(counts, lengths):
        if count:
            own = []
            while chain:
                own.append(chain[0])
                chain = chain[1]
            out.append((count, own))
    return out


def slots(found: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, last rank, first container) of every slot."""
    used: dict[int, int] = defaultdict(int)
    base, out = 0, []
    for count, lengths in found:
        for length in lengths:
            out.append((length, used[length], used[length] + count - 1, base))
            used[length] += count
        base += count
    return out


def pack(df: DataFrame, key: str, text: str, capacity: int = 2048) -> DataFrame:
    """``(key, piece, pieces, n_tokens, container)``: one row a piece of a text.

    A text of at most ``capacity`` tokens is one piece.  A larger one is cut into full
    pieces, which fill a container each, and a last piece with the rest.  Texts without
    tokens (null and empty ones too) have one row with container null.  Repeated keys
    count once, by their largest text.
    """
    spark = df.sparkSession
    sizes = cut(df.select(F.col(key).alias("key"), count_tokens(F.col(text)).alias("n")).groupBy("key").agg(F.max("n").alias("n")))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    items = sizes.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    items = items.withColumn("length", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int"))
    empty = items.where("n = 0").select("key", "piece", "pieces", F.col("length").alias("n_tokens"), F.lit(None).cast("long").alias("container"))
    items = items.where("n > 0").withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(BUCKETS)).cast("int"))

    parts = cut(items.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("c")))
    histogram = {r["length"]: r["c"] for r in parts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(slots(patterns(histogram, capacity)) or [(-1, 0, -1, 0)], "length int, low long, high long, base long")
    runs = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.greatest("high", "low") / BLOCK))))

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.withColumn("shift", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    within = Window.partitionBy("length", "bucket").orderBy("key", "piece")
    ranked = items.withColumn("own", F.row_number().over(within) - 1).join(small(shift), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("shift")).withColumn("block", F.floor(F.col("rank") / BLOCK))
    placed = ranked.join(small(runs), ["length", "block"]).where("rank between low and high")
    placed = placed.select("key", "piece", "pieces", F.col("length").alias("n_tokens"), (F.col("base") + F.col("rank") - F.col("low")).alias("container"))
    return placed.unionByName(empty).withColumnRenamed("key", key)


def filling(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the share of room used, and the lower bound of containers."""
    whole = packed.where("container is not null").agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return whole.select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        F.round(F.col("tokens") / F.greatest(F.lit(1), F.col("containers") * capacity), 6).alias("used"),
    )
