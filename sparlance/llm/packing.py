"""Problem 5: filling fixed-capacity containers with items.

Only the number of items of each length matters for a packing, and a capacity of C allows C
lengths at most. The plan is therefore made on the counts: items above a third of the
capacity are matched, at most two to a container, each with the largest partner that fits;
smaller items go, longest first, into the smallest gap that takes them. The plan says which
ranks of each length go to which run of containers. Items get their exact rank within their
length by a distributed count, and find their container by a join with the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparlance.operators.ranking import hashed_running
from sparlance.session import cut


class _Gaps:
    """Runs of containers by the room they have left."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in self.runs:
                insort(self.sizes, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The run with the smallest gap of `least` or more, removed: (gap, first, count)."""
        i = bisect_left(self.sizes, least)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, count = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.sizes[i]
        return gap, first, count


def plan_packing(counts: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Plan for (length, count) with 0 <= length <= capacity: rows (length, lo, hi, first_container,
    per_container), and the number of containers.

    The items of that length with ranks lo to hi - 1 go, per_container at a time, to the containers
    from first_container on. Items of length 0 are spread over all containers.
    """
    left = {n: c for n, c in counts if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps, containers = _Gaps(), 0

    def put(length: int, amount: int, first: int, per: int) -> None:
        plan.append((length, used[length], used[length] + amount, first, per))
        used[length] += amount

    large = sorted(n for n in left if 3 * n > capacity)
    open_lengths = large[:]
    for n in reversed(large):
        while left[n]:
            fit = bisect_left(open_lengths, capacity - n + 1) - 1
            while fit >= 0 and not left[open_lengths[fit]]:
                open_lengths.pop(fit)
                fit -= 1
            mate = open_lengths[fit] if fit >= 0 else None
            if mate == n and left[n] == 1:
                fit -= 1
                while fit >= 0 and not left[open_lengths[fit]]:
                    open_lengths.pop(fit)
                    fit -= 1
                mate = open_lengths[fit] if fit >= 0 else None
            if mate is None:
                put(n, left[n], containers, 1)
                gaps.add(capacity - n, containers, left[n])
                containers += left[n]
                left[n] = 0
            elif mate == n:
                pairs = left[n] // 2
                put(n, 2 * pairs, containers, 2)
                gaps.add(capacity - 2 * n, containers, pairs)
                containers += pairs
                left[n] -= 2 * pairs
            else:
                pairs = min(left[n], left[mate])
                put(n, pairs, containers, 1)
                put(mate, pairs, containers, 1)
                gaps.add(capacity - n - mate, containers, pairs)
                containers += pairs
                left[n] -= pairs
                left[mate] -= pairs
    for n in sorted((n for n in left if n and 3 * n <= capacity), reverse=True):
        while left[n]:
            run = gaps.take(n)
            if run is None:
                per = capacity // n
                run = (capacity, containers, -(-left[n] // per))
                containers += run[2]
            gap, first, count = run
            per = gap // n
            full = min(count, left[n] // per)
            if full:
                put(n, full * per, first, per)
                gaps.add(gap - per * n, first, full)
                left[n] -= full * per
            if full < count:
                rest, at = min(left[n], per), first + full
                if rest and full < count:
                    put(n, rest, at, rest)
                    gaps.add(gap - rest * n, at, 1)
                    left[n] -= rest
                    at += 1
                gaps.add(gap, at, first + count - at)
    if left.get(0):
        containers = max(containers, 1)
        per = -(-left[0] // containers)
        put(0, left[0], 0, per)
    return plan, containers


def message_lengths(records: DataFrame, key: str = "record_key") -> DataFrame:
    """(key, length): characters of all contents of a record; null contents count 0, null messages give no row."""
    total = F.aggregate(F.transform("messages", lambda m: F.coalesce(F.char_length(m["content"]), F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return records.where("messages is not null").select(F.col(key).alias("key"), total.alias("length"))


def pack(records: DataFrame, specs: DataFrame, key: str = "record_key") -> DataFrame:
    """(spec_id, container, key, piece, piece_length): every record with messages, for every spec, in a container.

    Only an item longer than the capacity is split: into pieces of full capacity, each filling a
    container, and a last piece that is packed like any other item. Pieces of an item are numbered
    from 0. Specs with a null capacity or one below 1 are left out, and an equal spec_id must not
    repeat. Empty records (length 0) are spread over the containers. Records with equal keys count
    as separate items, but get an arbitrary order among themselves.
    """
    spark = records.sparkSession
    wanted = [(r[0], int(r[1])) for r in specs.select("spec_id", "capacity_chars").where("spec_id is not null and capacity_chars >= 1").distinct().collect()]
    schema = f"spec_id string, container long, {key} long, piece int, piece_length long"
    if not wanted:
        return spark.createDataFrame([], schema)
    lengths = message_lengths(records, key)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in wanted]))
    items = lengths.select("key", "length", each.alias("s")).select("key", "length", "s.spec_id", "s.capacity")
    n_full = F.when(F.col("length") > F.col("capacity"), F.floor(F.col("length") / F.col("capacity"))).otherwise(0)
    last = F.col("length") - F.col("n_full") * F.col("capacity")
    pieces = items.withColumn("n_full", n_full.cast("int")).select(
        "spec_id", "key",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_full")), lambda i: F.when(i < F.col("n_full"), F.col("capacity")).otherwise(last))).alias("piece", "piece_length"),
    ).where("piece = 0 or piece_length > 0")
    pieces = cut(pieces)
    counts = pieces.groupBy("spec_id", "piece_length").count().collect()  # at most capacity + 1 rows for each spec
    rows = []
    for spec, capacity in wanted:
        plan, _ = plan_packing([(r["piece_length"], r["count"]) for r in counts if r["spec_id"] == spec], capacity)
        rows += [(spec, *p) for p in plan]
    planned = spark.createDataFrame(rows, "spec_id string, piece_length long, lo long, hi long, first long, per long")
    ranked = hashed_running(pieces, ["spec_id", "piece_length"], ["key", "piece"])
    # the plan has a few rows for each length of each spec, whatever the number of items
    placed = ranked.join(F.broadcast(planned), ["spec_id", "piece_length"]).where("rank >= lo and rank < hi")
    container = F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))
    return placed.select("spec_id", container.alias("container"), F.col("key").alias(key), "piece", "piece_length")


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, items, characters, and the filled share of all containers."""
    by_container = packed.groupBy("spec_id", "container").agg(F.sum("piece_length").alias("chars"), F.count("*").alias("pieces"), F.count_if(F.col("piece") == 0).alias("items"))
    by_spec = by_container.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("pieces").alias("pieces"), F.sum("chars").alias("chars"), F.max("chars").alias("fullest"))
    joined = by_spec.join(specs.select("spec_id", "capacity_chars"), "spec_id")
    return joined.select("spec_id", "capacity_chars", "items", "pieces", "containers", "chars", "fullest", (F.col("chars") / (F.col("containers") * F.col("capacity_chars"))).alias("filled_share"))
