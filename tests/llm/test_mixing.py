from collections import Counter, defaultdict

import pytest

from sparlance.llm import mixing

DOCS = "doc_id long, text string, source string, slot int, tokens long, block int, share double"
TARGETS = "source string, target_share double, max_repeats int, tokens long"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, s, 1, 2, 3, 0.5) for k, t, s in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame([(s, w, r, 9) for s, w, r in rows], TARGETS)


ROWS = [(i, "one two three four five " * (1 + i % 5), "ab"[i % 3 == 0]) for i in range(300)] + [(900 + i, "tiny text", "small") for i in range(5)] + [(950, "other", "unlisted"), (951, "none", None)]


def test_shares_caps_and_repeats(spark):
    wanted = targets(spark, [("a", 0.3, 2), ("b", 0.5, 3), ("small", 0.15, 4), ("absent", 0.05, 3)])
    mixed, quotas = mixing.mix(docs(spark, ROWS), wanted, block=256)
    out = mixed.collect()
    by = {q["source"]: q for q in quotas}
    total = sum(q["tokens"] for q in quotas)
    drawn, times = Counter(), Counter()
    for r in out:
        drawn[r["source"]] += r["n_tokens"]
        times[r["source"], r["doc_id"]] += 1
    assert set(drawn) == {"a", "b", "small"}
    assert drawn["a"] == pytest.approx(0.3 * total, abs=20) and drawn["b"] == pytest.approx(0.5 * total, abs=20)
    assert drawn["small"] == 4 * by["small"]["tokens"]
    assert all(n <= {"a": 2, "b": 3, "small": 4}[s] for (s, _), n in times.items())
    report = {r["source"]: r for r in mixing.mix_report(mixed, quotas).collect()}
    assert report["absent"]["drawn_tokens"] == 0 and report["a"]["actual_share"] == pytest.approx(0.3, abs=0.01)
    assert [tuple(r) for r in mixing.mix(docs(spark, ROWS), wanted, block=256)[0].orderBy("slot", "source", "at", "doc_id").collect()] == sorted((tuple(r) for r in out), key=lambda r: (r[0], r[2], r[1], r[4]))


def test_any_stretch_has_the_shares(spark):
    rows = [(i, "w " * 60, "abc"[i % 3]) for i in range(1500)]
    mixed, quotas = mixing.mix(docs(spark, rows), targets(spark, [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 1)]), block=512)
    slots = defaultdict(Counter)
    for r in mixed.collect():
        slots[r["slot"]][r["source"]] += r["n_tokens"]
    last = max(slots)
    for lo in range(0, last - 40, 20):
        got = Counter()
        for s in range(lo, lo + 40):
            got += slots[s]
        n = sum(got.values())
        assert got["a"] / n == pytest.approx(0.5, abs=0.1) and got["c"] / n == pytest.approx(0.2, abs=0.1)


def test_each_slot_is_taken_by_one_block(spark):
    quotas = [{"source": f"s{i}", "quota": q} for i, q in enumerate((900, 1, 17, 330, 64, 128, 5000, 2))]
    got = [tuple(r) for r in mixing._slots(spark, quotas, 8).collect()]
    total = sum(-(-q["quota"] // 8) for q in quotas)
    assert sorted(slot for _, _, slot in got) == list(range(total))
    for q in quotas:
        assert sorted(b for s, b, _ in got if s == q["source"]) == list(range(-(-q["quota"] // 8)))


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (4, "q" * 200_000, "a")]
    mixed, quotas = mixing.mix(docs(spark, rows), targets(spark, [("a", 1.0, 1), ("a", 0.0, 2), ("n", None, None), (None, 0.5, 1)]))
    assert {r["doc_id"] for r in mixed.collect()} == {1, 2, 3, 4}
    assert len(mixing.mix_report(mixed, quotas).collect()) == 2
    assert mixing.mix(docs(spark, []), targets(spark, [("a", 1.0, 1)]))[0].count() == 0
    assert mixing.mix(docs(spark, rows), targets(spark, []))[0].count() == 0
