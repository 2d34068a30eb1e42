"""Filling containers of fixed capacity with items of varying length.

Planning needs only the histogram of lengths, at most one count per length up to the capacity: best fit over counts, longest
first, where a group of equal containers takes a group of equal items at once. Items then take the planned slots by joining on
their rank within their length. Ranks come from counts per length and hash bucket, so a length that a third of all items share is
ranked in many tasks.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: (length, first_rank, items, first_container, each) rows.

    The `items` items of `length` from `first_rank` on fill containers first_container, first_container + 1, ... with `each` items
    apiece. Containers are numbered from 0. Lengths outside 1..capacity are not planned.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free space -> groups of (first container, containers)
    sizes: list[int] = []  # the free spaces, in order
    rows: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(space: int, group: tuple[int, int]) -> None:
        if space not in room:
            bisect.insort(sizes, space)
            room[space] = []
        room[space].append(group)

    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                each = capacity // length
                full = max(1, left // each)
                put(capacity, (made, full))
                made += full
                continue
            space = sizes[k]
            first, many = room[space].pop()
            if not room[space]:
                del room[space], sizes[k]
            each = min(space // length, left)
            used = min(many, left // each)
            rows.append((length, rank, used * each, first, each))
            rank += used * each
            left -= used * each
            if space - each * length:
                put(space - each * length, (first, used))
            if many > used:
                put(space, (first + used, many - used))
    return rows


#: Items of one length that are ranked in one task, about.
RANKED = 500_000


def ranked_within(items: DataFrame, key: str, order: str, buckets: int = 64) -> DataFrame:
    """Adds rank (from 0) within `key`, by hash bucket of `order`, then `order`; equal rows get different ranks."""
    df = items.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    sums = df.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order)) - 1
    return df.withColumn("_r", inside).join(sums, [key, "_b"]).withColumn("rank", F.col("_r") + F.col("_off")).drop("_b", "_r", "_off")


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """items (doc_id, tokens) -> doc_id, part, container, tokens: one row per piece of an item.

    An item is split only if it alone exceeds the capacity: into full pieces, each a container of its own, and a rest that is
    packed like any item. Items with null or no tokens need no container and give no rows. Repeated ids are items of their own.
    Shared containers are numbered from 0; the full pieces' containers carry negative numbers.
    """
    sized = items.filter("tokens > 0").select("doc_id", "tokens", (F.col("tokens") % capacity).alias("rest"), (F.col("tokens") / capacity).cast("int").alias("full"))
    rests = sized.filter("rest > 0")
    counts = {r.rest: r.n for r in rests.groupBy("rest").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = sorted(plan(counts, capacity))
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for length in counts:
        own = [r for r in rows[bisect.bisect_left(rows, (length,)) : bisect.bisect_left(rows, (length + 1,))]]
        by_length[length] = tuple(np.array([r[i] for r in own], np.int64) for i in (1, 3, 4))
    shared = items.sparkSession.sparkContext.broadcast(by_length)  # bounded by the capacity, not by the items

    def take(batches):
        slots = shared.value
        for pdf in batches:
            container = np.empty(len(pdf), np.int64)
            for length, at in pdf.groupby("rest").indices.items():
                first_rank, first, each = slots[length]
                rank = pdf["rank"].to_numpy()[at]
                k = np.searchsorted(first_rank, rank, side="right") - 1
                container[at] = first[k] + (rank - first_rank[k]) // each[k]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "part": pdf.full, "container": container, "tokens": pdf.rest.astype("int32")})

    schema = "doc_id long, part int, container long, tokens int"
    buckets = max(64, -(-max(counts.values(), default=0) // RANKED))
    placed = ranked_within(rests, "rest", "doc_id", buckets).select("doc_id", "rest", "full", "rank").mapInPandas(take, schema)
    whole = sized.filter("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("doc_id"))  # equal ids are items of their own
    own = -1 - F.abs(F.xxhash64("doc_id", "part", copy) % F.lit(2**62))
    whole = whole.select("doc_id", "part", own.alias("container"), F.lit(capacity).cast("int").alias("tokens"))
    return placed.unionByName(whole)


def fill_report(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """containers, tokens, fill (share of the capacity in use), least (containers that no packing could do without)."""
    each = pieces.groupBy("container").agg(F.sum("tokens").alias("t"))
    total = each.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return total.select("containers", "tokens", (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"), F.ceil(F.col("tokens") / capacity).alias("least"))
