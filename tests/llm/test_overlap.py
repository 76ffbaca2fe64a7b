import random

import numpy as np
import pytest

from sparlance.llm import overlap

SCHEMA = "record_key long, split_role string, split_id string, source string, messages array<struct<role:string,content:string>>, key long, words string, n int, h long"


def frame(spark, rows):
    return spark.createDataFrame([(k, r, "s", "src", m, 1, "w", 2, 3) for k, r, m in rows], SCHEMA)


def grams(messages):
    text = "\n".join((c or "") for r, c in messages if r in ("user", "assistant"))
    w = overlap.WORD.findall(text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows, t=0.7):
    sets = [(k, r.strip().lower(), grams(m)) for k, r, m in rows if r is not None and m is not None]
    out = {}
    for k, r, g in sets:
        for k2, r2, g2 in sets:
            if r == "train" and r2 != "train" and g and g2 and len(g & g2) >= t * len(g | g2) - 1e-12:
                out[min(k, k2), max(k, k2)] = len(g & g2) / len(g | g2)
    return out


def test_pairs_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["select", "from", "where"] * 4
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] for _ in range(40)]
    rows = []
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words) + 1)
            if rng.random() < 0.5:
                words.insert(at, rng.choice(vocabulary))
            elif len(words) > 3:
                words.pop(at - 1)
        cut = rng.randrange(len(words) + 1)
        m = [("system", "same words for all"), ("user", " ".join(words[:cut]).title()), ("assistant", "_".join(words[cut:]))]
        rows.append((i, rng.choice(["train", " Train", "validation", "proxy", ""]), m))
    got = {}
    for r in overlap.overlapping_pairs(frame(spark, rows)).collect():
        assert (min(r[:2]), max(r[:2])) not in got
        got[min(r[:2]), max(r[:2])] = r
    want = brute(rows)
    assert got.keys() == want.keys() and len(want) > 50
    for k, r in got.items():
        assert r["similarity"] == pytest.approx(want[k])
        assert 0 <= r["train_coverage"] <= 1 and (r["similarity"] < 1 or r["train_coverage"] > 0)


def test_nulls_short_texts_copies_and_empty_tables(spark):
    same = [("user", "one two three four"), ("assistant", None)]
    rows = [(1, "train", same), (2, "eval", same), (3, None, same), (4, "eval", None), (5, "train", [("user", "one two")]), (6, "eval", [("user", "one two")]), (7, "train", same), (8, "eval", []), (None, "eval", same)]
    got = {tuple(r) for r in overlap.pair_keys(overlap.overlapping_pairs(frame(spark, rows))).collect()}
    assert got == {(1, 2), (2, 7)}
    assert overlap.overlapping_pairs(frame(spark, [])).count() == 0
    members, pairs = overlap.record_classes_and_pairs(frame(spark, rows))
    report = overlap.overlap_report(frame(spark, rows), members, pairs).collect()
    assert sum(r["overlapping_rows"] for r in report) == 1 and sum(r["pairs"] for r in report) == 2
    links = {r["record_key"]: (r["class"], r["n_links"]) for r in overlap.overlap_members(members, pairs).collect()}
    assert links == {1: (1, 1), 2: (1, 1), 7: (1, 1)}


def test_very_long_text(spark):
    words = [f"x{i % 9973}y{i % 13}" for i in range(120_000)]
    other = words[:60_000] + ["changed"] + words[60_001:]
    rows = [(1, "train", [("user", " ".join(words))]), (2, "eval", [("user", " ".join(other))])]
    got = overlap.overlapping_pairs(frame(spark, rows)).collect()
    assert len(got) == 1 and got[0]["eval_coverage"] > 0.0


def test_hot_group_of_copies(spark):
    m = [("user", "alpha beta gamma delta epsilon")]
    rows = [(i, "train" if i % 2 else "eval", m) for i in range(300)]
    assert overlap.overlapping_pairs(frame(spark, rows)).count() == 150 * 150


def test_window_minima_cover_every_window():
    rng = np.random.default_rng(1)
    rank = rng.integers(0, 1000, 200)
    picked = set(overlap.window_minima(rank, 4))
    assert all(picked & set(range(i, i + 4)) for i in range(197))


@pytest.mark.parametrize("similarity", [0.6, 0.7, 0.8, 0.9])
def test_fingerprints_lose_no_pair(similarity):
    """Any two sequences that are similar enough share a fingerprint, whatever is rare in them."""
    rng = random.Random(5)
    tried = 0
    for _ in range(20_000):
        n = rng.randint(1, 14)
        a = rng.sample(range(40), n)
        b = [x if rng.random() < 0.9 else rng.randrange(40) for x in a if rng.random() < 0.95]
        b = list(dict.fromkeys(b + [rng.randrange(40) for _ in range(rng.choice((0, 0, 1, 2)))]))
        if rng.random() < 0.3:
            rng.shuffle(b)
        both = set(a) & set(b)
        if not both or len(both) < similarity * len(set(a) | set(b)) - 1e-9 or set(a) == set(b):
            continue
        tried += 1
        joinable = both | {x for x in range(40) if rng.random() < 0.5}
        rarity = {x: rng.randint(1, 3) for x in range(40)}
        side = []
        for own in (a, b):
            at = [i for i, x in enumerate(own) if x in joinable]
            h = np.array([own[i] for i in at], dtype=np.int64)
            offered, searched = overlap.fingerprints(len(own), np.array(at, dtype=np.int64), np.array([rarity[x] for x in h], dtype=np.int64), h, similarity)
            side.append(({int(h[i]) for i in offered}, {int(h[i]) for i in searched}))
        assert side[0][0] & side[1][1] and side[1][0] & side[0][1], (a, b)
    assert tried > 200


def test_hot_fingerprints_are_spread_and_the_filter_may_be_full(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", 3)
    monkeypatch.setattr(overlap, "FILTER_BITS", 1)
    monkeypatch.setattr(overlap, "FEW_KEYS", 1)
    rows = [(i, "train" if i % 3 else "eval", [("user", "one two three four five six seven eight nine ten eleven"), ("assistant", f"w{i}")]) for i in range(60)]
    got = {tuple(r) for r in overlap.pair_keys(overlap.overlapping_pairs(frame(spark, rows))).collect()}
    assert got == set(brute(rows)) and len(got) == 20 * 40


def test_alignment_covers_changed_words_and_turns_in_another_order():
    words = lambda s: np.array([hash(w) & 0xFFFF for w in s.split()], dtype=np.uint64)
    a = "a b c d e f g h i j k l m n o p q r s t".split()
    changed = [*a[:6], "X", *a[7:13], *a[14:]]
    assert overlap.chain_coverage(words(" ".join(a)), words(" ".join(changed)), 3) == (18, 18)
    turned = a[10:] + a[:10]
    assert overlap.chain_coverage(words(" ".join(a)), words(" ".join(turned)), 3)[0] >= 16
    twice = a + a
    assert overlap.chain_coverage(words(" ".join(twice)), words(" ".join(twice)), 3) == (40, 40)
