"""Problem 1: splits that keep related records together.

Records that share a dialog or a database, directly or through other records, form one
component. Components of equal size and label profile form bundles; a min-cost flow sends
the rows of bundles to the splits, paying for every row beyond a split's quota and for every
row by which a label is over-represented in a split. The flow is rounded to whole components,
and the members of a bundle are dealt out in hash order.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparlance.llm.common import clean_id
from sparlance.llm.components import connected_components
from sparlance.operators.ranking import hashed_running
from sparlance.session import cut

#: Cost of one row beyond a split's quota, and of one row beyond a label's share in a split.
OVER_QUOTA, OVER_LABEL = 100, 1


def _ids(records: DataFrame, key: str, label: str | None = None) -> DataFrame:
    named = [F.col(key).alias("key"), clean_id(F.col("dialog_id")).alias("dialog"), clean_id(F.col("database_id")).alias("database")]
    if label:
        named.append(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
    return records.select(*named)


def database_components(records: DataFrame) -> DataFrame:
    """(node, component) of every database that is connected to another one through dialogs.

    Each dialog contributes links from its smallest database to its other databases only, so
    the number of links is bounded by the distinct (dialog, database) pairs.
    """
    pairs = _ids(records, "record_key").select("dialog", "database").where("dialog is not null and database is not null").distinct()
    low = pairs.groupBy("dialog").agg(F.min("database").alias("low"), F.max("database").alias("high")).where("low <> high").select("dialog", "low")
    return connected_components(pairs.join(low, "dialog"), "low", "database")


def linked_databases(records: DataFrame) -> DataFrame:
    """(database_a, database_b), a < b: every two databases of one component.

    Null and blank ids connect nothing; repeated rows add nothing; an empty table gives no row.
    The result itself lists all pairs of a component; its input is one row per database.
    """
    members = cut(database_components(records))
    left = members.select("component", F.col("node").alias("database_a"))
    right = members.select("component", F.col("node").alias("database_b"))
    return left.join(right, "component").where("database_a < database_b").select("database_a", "database_b")


def record_components(records: DataFrame, key: str = "record_key", label: str = "source") -> DataFrame:
    """(key, label, component) for every record; a record with neither id is its own component."""
    ids = _ids(records, key, label)
    nodes = database_components(records).withColumnRenamed("node", "database")
    home = ids.where("dialog is not null and database is not null").groupBy("dialog").agg(F.min("database").alias("home"))
    known = ids.join(home, "dialog", "left").withColumn("database", F.coalesce("database", "home")).drop("home")
    placed = known.join(nodes, "database", "left")
    name = F.coalesce(
        F.concat(F.lit("b:"), F.coalesce("component", "database")),
        F.concat(F.lit("d:"), F.col("dialog")),
        F.concat(F.lit("r:"), F.col("key").cast("string")),
    )
    return placed.select("key", "label", name.alias("component"))


def component_profiles(members: DataFrame) -> DataFrame:
    """(component, n_rows, profile): profile is the component's most frequent label and its share in tenths."""
    by_label = members.groupBy("component", "label").agg(F.count("*").alias("n"))
    sizes = by_label.groupBy("component").agg(F.sum("n").alias("n_rows"), F.max(F.struct("n", "label")).alias("top"))
    share = F.floor(F.col("top.n") * 10 / F.col("n_rows")).cast("string")
    return sizes.select("component", "n_rows", F.col("top.label").alias("label"), F.concat_ws("|", "top.label", share).alias("profile"))


def min_cost_flow(n_nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a maximum flow of least cost; costs are not negative.

    Successive shortest paths with node potentials.
    """
    graph: list[list[int]] = [[] for _ in range(n_nodes)]
    head, left, cost = [], [], []
    for u, v, capacity, price in arcs:
        graph[u].append(len(head))
        graph[v].append(len(head) + 1)
        head += [v, u]
        left += [capacity, 0]
        cost += [price, -price]
    potential = [0] * n_nodes
    while True:
        distance, via, heap = [None] * n_nodes, [-1] * n_nodes, [(0, source)]
        distance[source] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            for e in graph[u]:
                if left[e] > 0:
                    v, new = head[e], d + cost[e] + potential[u] - potential[head[e]]
                    if distance[v] is None or new < distance[v]:
                        distance[v], via[v] = new, e
                        heapq.heappush(heap, (new, v))
        if distance[sink] is None:
            return [left[2 * i + 1] for i in range(len(arcs))]
        potential = [p + d if d is not None else p for p, d in zip(potential, distance)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = head[via[v] ^ 1]
        amount = min(left[e] for e in path)
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount


def allocate(bundles: list[tuple[int, str, str, int]], targets: list[tuple[str, float]]) -> list[tuple[int, str, str, int, int]]:
    """(size, profile, split, lo, hi) ranges of component ranks, from bundles (size, profile, label, count).

    Bundles that fit every quota are interchangeable within their label, so their supplies are
    merged into one node of the flow; a bundle larger than some quota has a node of its own,
    and pays for the part of it that cannot fit. There are at most sum(1 / share) such components.
    """
    total = sum(size * count for size, _, _, count in bundles)
    weight = sum(max(w, 0.0) for _, w in targets)
    if not total or weight <= 0:
        return []
    names = [s for s, _ in targets]
    shares = [max(w, 0.0) / weight for _, w in targets]
    quota = [round(total * w) for w in shares]
    fits = min((q for q, w in zip(quota, shares) if w > 0), default=0)
    supply: dict[tuple, int] = defaultdict(int)
    label_rows: dict[str, int] = defaultdict(int)
    for size, _, label, count in bundles:
        supply[(label, 0) if size <= fits else (label, size)] += size * count
        label_rows[label] += size * count
    labels, k = sorted(label_rows), len(names)
    keys = sorted(supply)
    at_supply = {key: 1 + i for i, key in enumerate(keys)}
    at_label = {(label, j): 1 + len(keys) + i * k + j for i, label in enumerate(labels) for j in range(k)}
    at_split = [1 + len(keys) + len(labels) * k + j for j in range(k)]
    sink = at_split[-1] + 1
    arcs = [(0, at_supply[key], supply[key], 0) for key in keys]
    tracked = {}
    for key in keys:
        for j in range(k):
            if shares[j] > 0:
                misfit = max(0, key[1] - quota[j])
                tracked[key, j] = len(arcs)
                arcs.append((at_supply[key], at_label[key[0], j], supply[key], OVER_QUOTA * misfit // max(1, key[1])))
    for label in labels:
        for j in range(k):
            arcs.append((at_label[label, j], at_split[j], round(label_rows[label] * shares[j]), 0))
            arcs.append((at_label[label, j], at_split[j], total, OVER_LABEL))
    for j in range(k):
        arcs.append((at_split[j], sink, quota[j], 0))
        arcs.append((at_split[j], sink, total, OVER_QUOTA))
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    want = {kj: flow[i] for kj, i in tracked.items()}
    room = quota[:]
    out = []
    for size, profile, label, count in sorted(bundles, key=lambda b: (-b[0], b[1])):
        key = (label, 0) if size <= fits else (label, size)
        dealt = [0] * k
        rest = count
        for j in range(k):
            if (key, j) in want:
                dealt[j] = max(0, min(rest, want[key, j] // size))
                rest -= dealt[j]
        while rest:  # whole components that no single split's flow covers: to the split with most room, at most a few per bundle
            j = max((j for j in range(k) if shares[j] > 0), key=lambda j: (room[j] - dealt[j] * size, shares[j]))
            step = 1
            dealt[j] += step
            rest -= step
        lo = 0
        for j in range(k):
            if dealt[j]:
                out.append((size, profile, names[j], lo, lo + dealt[j]))
                lo += dealt[j]
                room[j] -= dealt[j] * size
                if (key, j) in want:
                    want[key, j] = max(0, want[key, j] - dealt[j] * size)
    return out


def assign_splits(records: DataFrame, targets: DataFrame, *, key: str = "record_key", label: str = "source", seed: int = 1) -> DataFrame:
    """(key, component, split_name): one row per record, all records of a component in one split.

    targets has split_name and target_share; shares are taken relative to their sum, and null or
    negative shares count as 0. Null and blank ids connect nothing. Rows repeated under another
    key count like any other row. Only the bundle counts reach the driver: at most
    sqrt(2 x rows) sizes x 11 profiles per label. An empty table, or no share above 0, gives no row.
    """
    spark: SparkSession = records.sparkSession
    members = cut(record_components(records, key, label))
    profiles = component_profiles(members)
    bundles = [tuple(r) for r in profiles.groupBy("n_rows", "profile", "label").count().collect()]
    wanted = sorted((r[0], float(r[1] or 0)) for r in targets.where("split_name is not null").groupBy("split_name").agg(F.sum("target_share")).collect())
    ranges = spark.createDataFrame(allocate(bundles, wanted), "n_rows long, profile string, split_name string, lo long, hi long")
    ranked = hashed_running(profiles, ["n_rows", "profile"], ["component"], seed=seed)
    chosen = ranked.join(ranges, ["n_rows", "profile"]).where("rank >= lo and rank < hi").select("component", "split_name")
    return members.join(chosen, "component").select(F.col("key").alias(key), "component", "split_name")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows and components per split with target and actual share; a split without rows has 0."""
    got = assigned.groupBy("split_name", "component").agg(F.count("*").alias("n")).groupBy("split_name").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_components"))
    joined = targets.select("split_name", "target_share").join(got, "split_name", "left").fillna(0, ["n_rows", "n_components"])
    total = F.greatest(F.sum("n_rows").over(Window.partitionBy(F.lit(1))), F.lit(1))  # over the few splits
    return joined.select("split_name", "target_share", (F.col("n_rows") / total).alias("actual_share"), "n_rows", "n_components")
