import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparlance.llm import splits
from sparlance.llm.components import connected_components

SCHEMA = "record_key long, dialog_id string, database_id string, source string, component string, label string, rank int"
TARGETS = "split_name string, target_share double"


def records(spark, rows):
    return spark.createDataFrame([(k, d, b, s, "x", "y", 1) for k, d, b, s in rows], SCHEMA)


def targets(spark, shares=(("train", 0.8), ("validation", 0.1), ("test", 0.1))):
    return spark.createDataFrame(list(shares), TARGETS)


def brute_components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, d, b, _ in rows:
        ids = [("r", k)] + [(t, v.strip().lower()) for t, v in (("d", d), ("b", b)) if v and v.strip()]
        for other in ids[1:]:
            parent[find(ids[0])] = find(other)
    return {k: find(("r", k)) for k, *_ in rows}


ROWS = [
    (1, "d1", "A", "s"), (2, " D1 ", "b", "s"), (3, "d2", "B ", "s"), (4, "d3", "c", "t"), (5, None, "c", "t"), (6, "", "", "t"), (7, None, None, None), (8, "d9", None, "t"),
    (9, "d9", "\te", "t"), (10, "d9", None, None), (11, "d1", "a", "s"),
]


def test_components_match_brute_force(spark):
    got = {r["key"]: r["component"] for r in splits.record_components(records(spark, ROWS)).collect()}
    want = brute_components(ROWS)
    assert got.keys() == want.keys()
    for a, b in itertools.combinations(got, 2):
        assert (got[a] == got[b]) == (want[a] == want[b]), (a, b)


def test_linked_databases(spark):
    got = {tuple(r) for r in splits.linked_databases(records(spark, ROWS)).collect()}
    assert got == {("a", "b")}


def test_long_chain_settles(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(120)] + [("x", "x"), (None, "y"), ("n000", "n001")], "l string, r string")
    got = connected_components(links, "l", "r").collect()
    assert len(got) == 121 and {r["component"] for r in got} == {"n000"}


def test_assignment_keeps_components_and_shares(spark):
    rows = [(i, f"d{i // 3}", f"b{i // 12}" if i % 2 else None, f"s{i % 4}") for i in range(1200)] + [(2000 + i, f"hot{i}", "hot", "s1") for i in range(500)]
    df = records(spark, rows)
    out = splits.assign_splits(df, targets(spark)).collect()
    assert sorted(r["record_key"] for r in out) == sorted(r[0] for r in rows)
    home = {}
    for r in out:
        assert home.setdefault(r["component"], r["split_name"]) == r["split_name"]
    share = {s: sum(r["split_name"] == s for r in out) / len(out) for s in ("train", "validation", "test")}
    assert share["train"] == pytest.approx(0.8, abs=0.02) and share["test"] == pytest.approx(0.1, abs=0.02)
    again = splits.assign_splits(df, targets(spark)).collect()
    assert {(r["record_key"], r["split_name"]) for r in out} == {(r["record_key"], r["split_name"]) for r in again}
    report = {r["split_name"]: r for r in splits.split_report(splits.assign_splits(df, targets(spark)), targets(spark)).collect()}
    assert sum(r["n_rows"] for r in report.values()) == len(rows)


def test_nulls_repeats_and_empty_tables(spark):
    out = splits.assign_splits(records(spark, [*ROWS, ROWS[0]]), targets(spark, (("train", 0.5), ("test", None), (None, 0.5)))).collect()
    assert len(out) == 12 and {r["split_name"] for r in out} == {"train"}
    assert splits.assign_splits(records(spark, []), targets(spark)).count() == 0
    assert splits.assign_splits(records(spark, ROWS), targets(spark, ())).count() == 0
    assert splits.linked_databases(records(spark, [])).count() == 0


def test_component_larger_than_a_small_quota_goes_to_a_large_split():
    plan = splits.allocate([(90, "p", "l", 1), (1, "p", "l", 60)], [("test", 0.1), ("train", 0.9)])
    assert [r for r in plan if r[0] == 90] == [(90, "p", "train", 0, 1)]
    assert sum((hi - lo) * size for size, _, split, lo, hi in plan if split == "test") == 15


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(1, 30), st.sampled_from("abc")), st.integers(1, 40), min_size=1, max_size=12), st.lists(st.integers(1, 10), min_size=1, max_size=4))
def test_every_component_is_dealt_once(sizes, weights):
    bundles = [(s, f"{lab}|9", lab, n) for (s, lab), n in sizes.items()]
    plan = splits.allocate(bundles, [(f"s{i}", w) for i, w in enumerate(weights)])
    for s, p, _, n in bundles:
        got = sorted((lo, hi) for size, profile, _, lo, hi in plan if (size, profile) == (s, p))
        assert got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    total, largest = sum(s * n for s, _, _, n in bundles), max(s for s, *_ in bundles)
    for i, w in enumerate(weights):
        rows = sum((hi - lo) * s for s, _, split, lo, hi in plan if split == f"s{i}")
        assert abs(rows - total * w / sum(weights)) <= (len(bundles) + 2) * largest


def test_min_cost_flow_against_all_integral_flows():
    arcs = [(0, 1, 3, 0), (0, 2, 2, 0), (1, 3, 2, 1), (1, 4, 3, 4), (2, 3, 2, 2), (2, 4, 2, 1), (3, 5, 3, 0), (4, 5, 3, 0)]
    best = None
    for f in itertools.product(*[range(c + 1) for _, _, c, _ in arcs]):
        net = [0] * 6
        for (u, v, _, _), x in zip(arcs, f):
            net[u] -= x
            net[v] += x
        if net[1:5] == [0] * 4:
            key = (-net[5], sum(x * a[3] for x, a in zip(f, arcs)))
            best = key if best is None or key < best else best
    got = splits.min_cost_flow(6, arcs, 0, 5)
    assert (-(got[0] + got[1]), sum(x * a[3] for x, a in zip(got, arcs))) == best
