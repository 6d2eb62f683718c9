"""Problem 8: filling containers of fixed capacity, shortest pack first.

Items are reduced to a histogram of their lengths (at most ``capacity`` entries). The
driver places whole groups of equal lengths, longest first, always into the container
with the most room, and keeps the result as packing patterns with multiplicities. Items
then find their container by their rank among items of the same length, so no item moves
to the driver and no two items are compared.

Items longer than the capacity are cut into full containers and a rest; others are
never split.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CAPACITY = 1024
#: Rows of the pattern table that may be sent to every task; beyond it Spark picks the join.
PATTERN_ROWS = 100_000


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns ``(lengths, longest first)`` with how often each is used."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            widest = max(room, default=-1)
            if widest < length:
                # none has room for it: open containers
                room.setdefault(capacity - length, []).append(((length,), left))
                break
            pattern, times = room[widest].pop()
            if not room[widest]:
                del room[widest]
            used = min(times, left)
            if used < times:
                room.setdefault(widest, []).append((pattern, times - used))
            room.setdefault(widest - length, []).append((pattern + (length,), used))
            left -= used
    merged: Counter = Counter()
    for packs in room.values():
        for pattern, times in packs:
            merged[pattern] += times
    return sorted(merged.items(), key=lambda x: (x[0], x[1]), reverse=True)


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank behind the last, items a container, first container)."""
    rows, taken, container = [], Counter(), 0
    for pattern, times in patterns:
        for length, per in sorted(Counter(pattern).items()):
            rows.append((length, taken[length], taken[length] + per * times, per, container))
            taken[length] += per * times
        container += times
    return rows


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """Container of every part of every item.

    ``items`` has a key and a length; other columns are ignored. Rows with a null key or
    with a null, zero or negative length are not placed. Repeated keys are separate items.
    Returns ``(container, item, part, n_parts, start, length)``: part ``part`` of ``n_parts``
    covers ``length`` units from ``start``. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = items.sparkSession
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sized = cut_lineage(
        items.select(F.col(key).alias("item"), F.col(size).cast("long").alias("n")).where(F.col("item").isNotNull() & (F.col("n") > 0))
    )
    parts = (
        sized.withColumn("n_parts", F.ceil(F.col("n") / capacity).cast("int"))
        .select("item", "n", "n_parts", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
        .select(
            "item",
            "part",
            "n_parts",
            (F.col("part").cast("long") * capacity).alias("start"),
            F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part").cast("long") * capacity).alias("length"),
            F.pmod(F.xxhash64("item", "part"), F.lit(buckets)).alias("bucket"),
        )
    )
    counts = cut_lineage(parts.groupBy("length", "bucket").agg(F.count("*").alias("k")))
    histogram = {r.length: r.k for r in counts.groupBy("length").agg(F.sum("k").alias("k")).collect()}
    places = _places(shortest_pack_first(histogram, capacity))
    # ranks within a length: by bucket, then inside the bucket, so a common length is spread
    before = F.coalesce(F.sum("k").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("item", "part")) - 1
    ranked = parts.withColumn("inside", inside).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    schema = "of_length long, lo long, hi long, per long, first_container long"
    table = spark.createDataFrame(places, schema)
    if len(places) <= PATTERN_ROWS:
        table = F.broadcast(table)
    found = ranked.join(table, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")).cast("long")
    return found.select(container.alias("container"), "item", "part", "n_parts", "start", "length")


def container_contents(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Contents and unused space of each container: ``(container, items, used, free)``."""
    content = F.sort_array(F.collect_list(F.struct("item", "part", "start", "length")))
    return packed.groupBy("container").agg(content.alias("items"), F.sum("length").alias("used")).withColumn("free", F.lit(capacity) - F.col("used"))
