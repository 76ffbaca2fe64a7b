import math
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparlance.llm import packing

SCHEMA = "record_key long, messages array<struct<role:string,content:string>>, length long, rank int, spec_id string"
SPECS = "spec_id string, capacity_chars int, note string"


def frame(spark, rows):
    return spark.createDataFrame([(k, m, 1, 2, "z") for k, m in rows], SCHEMA)


def specs(spark, rows=(("a", 100),)):
    return spark.createDataFrame([(s, c, "n") for s, c in rows], SPECS)


def contents(plan):
    held = defaultdict(list)
    for n, lo, hi, first, per in plan:
        for r in range(lo, hi):
            held[first + (r - lo) // per].append(n)
    return held


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(0, 60), max_size=80))
def test_plan_places_all_and_fits(capacity, lengths):
    lengths = [n for n in lengths if n <= capacity]
    plan, containers = packing.plan_packing(Counter(lengths).items(), capacity)
    held = contents(plan)
    assert sorted(x for xs in held.values() for x in xs) == sorted(lengths)
    assert all(sum(xs) <= capacity for xs in held.values())
    assert set(held) <= set(range(containers))
    assert all(xs for i, xs in held.items()) and len([i for i in held if sum(held[i])]) == (containers if sum(lengths) else len([i for i in held if sum(held[i])]))
    assert sum(3 * x > capacity for x in max(held.values(), key=lambda xs: sum(3 * x > capacity for x in xs), default=[])) <= 2
    if lengths:
        ffd = []
        for n in sorted(lengths, reverse=True):
            i = next((i for i, s in enumerate(ffd) if s + n <= capacity), None)
            if i is None:
                ffd.append(n)
            else:
                ffd[i] += n
        assert containers <= 1.5 * len(ffd) + 1


def test_fill_is_close_to_the_bound():
    import random

    rng = random.Random(5)
    lengths = [min(4096, int(rng.lognormvariate(7, 0.7)) + 1) for _ in range(20_000)]
    _, containers = packing.plan_packing(Counter(lengths).items(), 4096)
    assert containers <= 1.02 * max(math.ceil(sum(lengths) / 4096), sum(n > 2048 for n in lengths))


def test_frames(spark):
    rows = [(1, [("user", "x" * 60)]), (2, [("user", "y" * 40), ("assistant", None)]), (3, [("user", "z" * 250)]), (4, None), (5, []), (6, [("user", None)]), (7, [("user", "é" * 30)]), (1, [("user", "x" * 60)]), (8, [("a", "x" * 100)])]
    out = packing.pack(frame(spark, rows), specs(spark, (("a", 100), ("b", 1000), ("bad", None), ("zero", 0)))).collect()
    for spec, capacity in (("a", 100), ("b", 1000)):
        mine = [r for r in out if r["spec_id"] == spec]
        room = Counter()
        for r in mine:
            room[r["container"]] += r["piece_length"]
        assert max(room.values()) <= capacity
        assert Counter(r["record_key"] for r in mine if r["piece"] == 0) == Counter({1: 2, 2: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1})
        assert sum(r["piece_length"] for r in mine if r["record_key"] == 3) == 250
        assert len([r for r in mine if r["record_key"] == 3]) == (3 if capacity == 100 else 1)
        assert len([r for r in mine if r["record_key"] == 8]) == 1
    report = {r["spec_id"]: r for r in packing.packing_report(packing.pack(frame(spark, rows), specs(spark)), specs(spark)).collect()}
    assert report["a"]["items"] == 8 and report["a"]["chars"] == 540 and report["a"]["fullest"] == 100


def test_hot_length_and_empty_tables(spark):
    out = packing.pack(frame(spark, [(i, [("user", "w" * 30)]) for i in range(1000)]), specs(spark)).collect()
    room = Counter(r["container"] for r in out)
    assert len(out) == 1000 and len({r["record_key"] for r in out}) == 1000 and max(room.values()) == 3 and len(room) == 334
    assert packing.pack(frame(spark, []), specs(spark)).count() == 0
    assert packing.pack(frame(spark, [(1, [])]), specs(spark, ())).count() == 0
    assert packing.pack(frame(spark, [(1, None)]), specs(spark)).count() == 0
    with pytest.raises(Exception):
        packing.pack(frame(spark, []).drop("messages"), specs(spark)).count()
