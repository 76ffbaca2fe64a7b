"""Problem 2: the same or nearly the same records in training and evaluation splits.

Winnowing. A rolling hash runs over the words of a record; hashes are ordered by how rare they
are (counted exactly over all records), and the smallest of each window is a fingerprint.
Records are joined across splits on their fingerprints. On each joined pair common fingerprints
are chained where they rise in both texts, the stretches between them and at the ends are
aligned word by word with substitutions and gaps, and what is left is chained again, so that
turns in another order are covered too. The aligned words are each record's coverage; the
similarity of the two sets of hashes is checked exactly at the end.

Why no pair of similarity t is missed (t > 0.5). Take the distinct hashes of A in the order in which they first
occur. Those that B lacks, u of them, cut the others into at most u + 1 runs. As t n > (1 - t) n + 1,
some run has two hashes or more; let m be the smallest hash in such runs. Its neighbour in the run is
larger, so m is the minimum of a window of two. Smaller than m are in A only the hashes that B lacks
and runs of one, in B only those that A lacks and runs of one, so m is among the smallest 2 u + 1 of A and
the smallest (1 - t) / t n + 1 of B. The train side therefore offers the window minima among its
first 2 u + 1 hashes, u being what t allows at most, and the evaluation side is searched by its
first (1 - t) / t n + 1 ones. A hash that only one side has is smaller than every other, and is never joined.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparlance.llm.common import clean_id, trimmed
from sparlance.session import cut

WORD = re.compile(r"[^\W_]+")
#: Hashes in a window of the join: the widest for which the search is lossless.
WINDOW = 2
#: Hashes in a window whose minimum may be a seed of an alignment.
SEED_WINDOW = 4
#: Bits of the filter that keeps hashes of one side only out of the shuffle: a bound on its size (32 MB), and bits for each hash it holds.
FILTER_BITS, BITS_EACH = 1 << 28, 16
#: So many keys may be broadcast, 16 bytes each.
FEW_KEYS = 1 << 18
#: A fingerprint that more train records than this have is spread over tasks.
HOT = 4096
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word met; forgets all of them before it grows beyond a million."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of a text, in order."""
        return np.array(list(map(self.__getitem__, WORD.findall(text.lower()))), dtype=np.uint64)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; empty if there are fewer than k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total = total * _MULTIPLIER + words[i : i + n]
        return _mix(total)


def in_order(shingles: np.ndarray) -> np.ndarray:
    """Distinct shingles in the order in which they first occur."""
    unique, first = np.unique(shingles, return_index=True)
    return unique[np.argsort(first, kind="stable")]


def window_minima(rank: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest rank in each run of `window` positions (all of the run if it is shorter)."""
    n = len(rank)
    if n <= window:
        return np.array([int(np.argmin(rank))]) if n else np.empty(0, dtype=int)
    view = np.lib.stride_tricks.sliding_window_view(rank, window)
    return np.unique(np.arange(n - window + 1) + view.argmin(axis=1))


def may_lack(n: int, similarity: float) -> int:
    """How many of a set's n hashes a partner of that similarity lacks at most."""
    return n - math.ceil(similarity * n - 1e-9)


def may_differ(n: int, similarity: float) -> int:
    """How many hashes one of a set of n and its partner has without the other, at most."""
    return math.floor((1 - similarity) / similarity * n + 1e-9)


def fingerprints(n: int, position: np.ndarray, rarity: np.ndarray, h: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(offered, searched): which of a record's hashes it offers as a train record and is searched by as another one.

    The record has n distinct hashes; position, rarity and h are those of the hashes that both
    sides have. The others come first in the order.
    """
    alone = n - len(h)
    none = np.empty(0, dtype=int)
    if not len(h):
        return none, none
    order = np.lexsort((h, rarity))
    rank = np.zeros(n, dtype=np.int64)  # 0: only one side has it
    rank[position[order]] = alone + np.arange(len(h))
    at = np.empty(len(h), dtype=np.int64)
    at[order] = alone + np.arange(len(h))
    searched = np.flatnonzero(at <= may_differ(n, similarity)) if alone <= may_differ(n, similarity) else none
    lack = may_lack(n, similarity)
    if alone > lack:
        return none, searched
    if n * (2 * similarity - 1) <= 1:  # too short for runs of two
        return np.arange(len(h)), searched
    minimum = np.zeros(n, dtype=bool)
    minimum[window_minima(rank, WINDOW)] = True
    return np.flatnonzero((at <= 2 * lack) & minimum[position]), searched


def record_texts(records: DataFrame, key: str = "record_key") -> DataFrame:
    """(key, is_train, text) of each record with a key, a role and messages; null contents are empty texts."""
    spoken = F.filter("messages", lambda m: F.lower(trimmed(m["role"])).isin("user", "assistant"))
    text = F.concat_ws("\n", F.transform(spoken, lambda m: F.coalesce(m["content"], F.lit(""))))
    role = F.lower(trimmed(F.col("split_role")))
    kept = records.where(F.col("split_role").isNotNull() & F.col("messages").isNotNull() & F.col(key).isNotNull())
    return kept.select(F.col(key).alias("key"), (role == "train").alias("is_train"), text.alias("text"))


def shared_shingles(texts: DataFrame, k: int) -> DataFrame:
    """(h, rarity): the shingles that both a train record and another one have, and how many records have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            got = [(np.unique(rolling(known.of(t), k)), 1 if train else 2) for train, t in zip(pdf.is_train, pdf.text)]
            if got:
                yield pd.DataFrame({"h": np.concatenate([s for s, _ in got]).view(np.int64), "side": np.concatenate([np.full(len(s), side, dtype=np.int32) for s, side in got])})

    counted = texts.select("is_train", "text").mapInPandas(run, "h long, side int").groupBy("h").agg(F.count("*").alias("rarity"), F.bit_or("side").alias("side"))
    return counted.where("side = 3").select("h", "rarity")


def _filter_of(shared: DataFrame) -> np.ndarray:
    """Bits by hash of the shared shingles. It only spares the shuffle what cannot join; its size is bounded, and once it
    is full everything passes. Each slice of it is put together where its hashes are; only bits reach the driver."""
    bits = 1 << 12
    while bits < min(FILTER_BITS, BITS_EACH * shared.count()):
        bits *= 2
    slices = max(1, bits >> 20)
    each = bits // slices
    at = shared.selectExpr(f"h & {bits - 1}L AS at")
    words = at.selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, int(at & 63)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    placed = words.withColumn("slice", F.floor(F.col("word") * 64 / each).cast("int")).repartition("slice")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, np.ndarray] = {}
        for pdf in batches:
            for s, part in pdf.groupby("slice"):
                block = blocks.setdefault(int(s), np.zeros(each // 64, dtype=np.int64))
                block[part.word.to_numpy() - int(s) * (each // 64)] = part.bit.to_numpy()
        yield pd.DataFrame({"slice": list(blocks), "block": [b.tobytes() for b in blocks.values()]})

    full = np.zeros(bits // 64, dtype=np.int64)
    for s, block in placed.mapInPandas(run, "slice int, block binary").toLocalIterator():
        full[s * (each // 64) : (s + 1) * (each // 64)] = np.frombuffer(block, dtype=np.int64)
    return full


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1


def record_shingles(texts: DataFrame, shared: DataFrame, *, similarity: float, k: int) -> DataFrame:
    """(key, is_train, class_hi, class_lo, n, position, h) of each text of k words or more.

    class_hi and class_lo name its set of shingles, n of them: exact copies and texts that differ
    only in repetition fall into one class. position and h are those of its shingles, in the order in
    which they first occur, that pass the filter of the shared ones; empty where so many fail it that no partner is possible.
    """
    filter_ = texts.sparkSession.sparkContext.broadcast(_filter_of(shared))
    most = lambda n: max(may_lack(n, similarity), may_differ(n, similarity))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, known, none = filter_.value, WordHashes(), np.empty(0, dtype=np.int64)
        for pdf in batches:
            out = []
            for key, train, text in zip(pdf.key, pdf.is_train, pdf.text):
                own = in_order(rolling(known.of(text), k))
                n = len(own)
                if n:
                    with np.errstate(over="ignore"):
                        hi = _mix(own).sum(dtype=np.uint64)
                        lo = _mix(own * _MULTIPLIER + np.uint64(1)).sum(dtype=np.uint64)
                    at = np.flatnonzero(_passes(own, bits))
                    if n - len(at) > most(n):
                        at = none
                    out.append((key, bool(train), np.int64(hi.view(np.int64)), np.int64(lo.view(np.int64)), n, at.astype(np.int32), own[at].view(np.int64)))
            yield pd.DataFrame(out, columns=["key", "is_train", "class_hi", "class_lo", "n", "position", "h"])

    return texts.mapInPandas(run, "key long, is_train boolean, class_hi long, class_lo long, n int, position array<int>, h array<long>")


def record_fingerprints(shingles: DataFrame, shared: DataFrame, *, similarity: float) -> DataFrame:
    """(h, key, n, offered, searched) of each fingerprint of each record, from (key, n, position, h) with arrays."""
    spread = shingles.where(F.size("h") > 0).select("key", "n", F.explode(F.arrays_zip("position", "h")).alias("s")).select("key", "n", "s.position", "s.h")
    each = spread.join(shared, "h").groupBy("key").agg(F.max("n").alias("n"), F.collect_list(F.struct("position", "rarity", "h")).alias("met"))  # of one text

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, n, met_ in zip(pdf.key, pdf.n, pdf.met):
                position, rarity, h = (np.array([m[c] for m in met_], dtype=np.int64) for c in ("position", "rarity", "h"))
                offered, searched = fingerprints(n, position, rarity, h, similarity)
                a, b = set(offered.tolist()), set(searched.tolist())
                out += [(int(h[i]), key, n, i in a, i in b) for i in sorted(a | b)]
            yield pd.DataFrame(out, columns=["h", "key", "n", "offered", "searched"])

    return each.mapInPandas(choose, "h long, key long, n int, offered boolean, searched boolean")


def candidate_pairs(seeds: DataFrame, *, similarity: float) -> DataFrame:
    """(a, b): classes of train and of other records that share a fingerprint and could be that similar by their sizes.

    The join also goes by a band of sizes, as only sets of like size can be similar; a fingerprint that
    many train records of a band have is spread over several tasks, to each of which its searches are sent.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(similarity))).cast("int")
    left = cut(seeds.where("offered and has_train").select("h", band.alias("band"), F.col("class").alias("a"), F.col("n").alias("na")))
    near = seeds.where("searched and has_eval").select("h", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("class").alias("b"), F.col("n").alias("nb"))
    hot = left.groupBy("h", "band").agg(F.count("*").alias("many")).where(F.col("many") > HOT).select("h", "band", F.ceil(F.col("many") / HOT).cast("int").alias("parts"))
    left = left.join(hot, ["h", "band"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    near = near.join(hot, ["h", "band"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    possible = (F.col("a") != F.col("b")) & (F.col("nb") >= F.col("na") * similarity - 1e-6) & (F.col("na") >= F.col("nb") * similarity - 1e-6)
    return left.join(near, ["h", "band", "part"]).where(possible).select("a", "b").distinct()


# ---------------------------------------------------------------- chains and alignment


def _aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Words that agree in the best alignment of two stretches, with substitutions and gaps (by bit vectors)."""
    if not len(a) or not len(b):
        return 0
    at: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a.tolist():
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _rising(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of seeds that rises in both texts."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(seeds)
    for x, (_, j) in enumerate(seeds):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(x)
        else:
            tails[p], at[p] = j, x
        back[x] = at[p - 1] if p else -1
    chain, x = [], at[-1] if at else -1
    while x >= 0:
        chain.append(seeds[x])
        x = back[x]
    return chain[::-1]


def chain_coverage(a: np.ndarray, b: np.ndarray, k: int, window: int = SEED_WINDOW) -> tuple[int, int]:
    """Words of a and of b that agree in chains of common fingerprints and the alignments around them.

    Seeds are window minima; a fingerprint that occurs several times pairs its first place in a with
    its first in b, its second with its second, and so on. The longest chain that rises in both
    grows to both sides while words agree; the seeds it leaves form further chains in the words that are
    left. Then the stretches between the seeds of a chain and beyond its ends are aligned,
    with substitutions and gaps.
    """
    sa, sb = rolling(a, k), rolling(b, k)
    places: dict[int, list[int]] = defaultdict(list)
    for j in window_minima(sb, window):
        places[int(sb[j])].append(int(j))
    met: dict[int, int] = defaultdict(int)
    seeds = []
    for i in window_minima(sa, window):
        h = int(sa[i])
        if met[h] < len(places.get(h, ())):
            seeds.append((int(i), places[h][met[h]]))
            met[h] += 1
    in_a, in_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    chains: list[list[tuple[int, int, int, int]]] = []
    while seeds:
        chain = _rising(seeds)
        spans = []
        for i, j in chain:
            if in_a[i : i + k].any() or in_b[j : j + k].any():
                continue
            lo, hi = 0, k
            while i > lo and j > lo and not in_a[i - lo - 1] and not in_b[j - lo - 1] and a[i - lo - 1] == b[j - lo - 1]:
                lo += 1
            while i + hi < len(a) and j + hi < len(b) and not in_a[i + hi] and not in_b[j + hi] and a[i + hi] == b[j + hi]:
                hi += 1
            in_a[i - lo : i + hi] = in_b[j - lo : j + hi] = True
            spans.append((i - lo, i + hi, j - lo, j + hi))
        if spans:
            chains.append(spans)
        gone = set(chain)
        seeds = [s for s in seeds if s not in gone]
    agree = int(in_a.sum())
    for spans in chains:
        edges = [(0, 0, 0, 0), *spans, (len(a), len(a), len(b), len(b))]
        for x, y in zip(edges, edges[1:]):
            i, j = slice(x[1], y[0]), slice(x[3], y[2])
            agree += _aligned(a[i][~in_a[i]], b[j][~in_b[j]])
            in_a[i] = in_b[j] = True
    return agree, agree


# ---------------------------------------------------------------- the whole search


def record_classes_and_pairs(records: DataFrame, *, similarity: float = 0.7, k: int = 3, key: str = "record_key") -> tuple[DataFrame, DataFrame]:
    """(members, pairs). members: (key, is_train, class) of each record that can be in a pair; a class is named by its smallest key.
    pairs: (train_class, eval_class, similarity, train_coverage, eval_coverage), a class with both kinds of records also with itself.

    Roles are trimmed and compared in lower case; rows with a null role or null messages, and rows of
    fewer than k words or without a key, are in no class. Null contents are empty texts. An empty table
    gives no row.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("the search is lossless for similarities above 0.5 only")
    texts = record_texts(records, key)
    shared = cut(shared_shingles(texts, k))
    rows = cut(record_shingles(texts, shared, similarity=similarity, k=k))
    name = ["class_hi", "class_lo"]
    classes = rows.groupBy(*name).agg(F.min("key").alias("class"), F.max("is_train").alias("has_train"), F.max(~F.col("is_train")).alias("has_eval"))
    classes = cut(classes)
    members = rows.select("key", "is_train", *name).join(classes.select(*name, "class"), name).select("key", "is_train", "class")
    firsts = classes.select(F.col("class").alias("key"), "has_train", "has_eval")
    # a key that is repeated with other messages counts by one of its texts
    one_each = rows.where(F.size("h") > 0).join(firsts.select("key"), "key", "left_semi").dropDuplicates(["key"])
    seeds = record_fingerprints(one_each, shared, similarity=similarity).join(firsts, "key").withColumnRenamed("key", "class")
    candidates = cut(candidate_pairs(cut(seeds), similarity=similarity))
    wanted = candidates.select(F.col("a").alias("key")).unionByName(candidates.select(F.col("b").alias("key"))).distinct()
    wanted = cut(wanted)
    few = F.broadcast(wanted) if wanted.count() <= FEW_KEYS else wanted
    one = texts.join(few, "key").groupBy("key").agg(F.min("text").alias("text"))  # a key that is repeated has one text
    one = cut(one)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            out = []
            for a, b, ta, tb in zip(pdf.a, pdf.b, pdf.text_a, pdf.text_b):
                wa, wb = known.of(ta), known.of(tb)
                ua, ub = np.unique(rolling(wa, k)), np.unique(rolling(wb, k))
                both = len(np.intersect1d(ua, ub, assume_unique=True))
                union = len(ua) + len(ub) - both
                if both >= similarity * union - 1e-9:
                    ca, cb = chain_coverage(wa, wb, k)
                    out.append((a, b, both / union, ca / len(wa), cb / len(wb)))
            yield pd.DataFrame(out, columns=["train_class", "eval_class", "similarity", "train_coverage", "eval_coverage"])

    schema = "train_class long, eval_class long, similarity double, train_coverage double, eval_coverage double"
    text_of = lambda c: one.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}"))
    found = candidates.join(text_of("a"), "a").join(text_of("b"), "b").mapInPandas(verify, schema)
    itself = classes.where("has_train and has_eval").select(F.col("class").alias("train_class"), F.col("class").alias("eval_class"), *[F.lit(1.0).alias(c) for c in ("similarity", "train_coverage", "eval_coverage")])
    return members, cut(found.unionByName(itself))


def overlapping_pairs(records: DataFrame, *, similarity: float = 0.7, k: int = 3, key: str = "record_key") -> DataFrame:
    """(train_key, eval_key, similarity, train_coverage, eval_coverage) of every pair of a train record
    and a record of another role whose sets of k-word shingles have that Jaccard similarity or more.

    Copies are compared once, by their class, and listed again in the result; see record_classes_and_pairs
    for what counts.
    """
    members, pairs = record_classes_and_pairs(records, similarity=similarity, k=k, key=key)
    trains = members.where("is_train").select(F.col("key").alias("train_key"), F.col("class").alias("train_class"))
    evals = members.where("not is_train").select(F.col("key").alias("eval_key"), F.col("class").alias("eval_class"))
    return pairs.join(trains, "train_class").join(evals, "eval_class").select("train_key", "eval_key", "similarity", "train_coverage", "eval_coverage")


def pair_keys(pairs: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b."""
    return pairs.select(F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b"))


def overlap_members(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record_key, is_train, class, n_links) of each record in a class: with how many classes of the other side it is paired."""
    links = pairs.select(F.col("train_class").alias("class"), F.lit(True).alias("is_train")).unionByName(pairs.select(F.col("eval_class").alias("class"), F.lit(False).alias("is_train")))
    counted = links.groupBy("class", "is_train").agg(F.count("*").alias("n_links"))
    return members.join(counted, ["class", "is_train"], "left").select(F.col("key").alias("record_key"), "is_train", "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def overlap_report(records: DataFrame, members: DataFrame, pairs: DataFrame, key: str = "record_key") -> DataFrame:
    """Per split_id and source of evaluation rows: rows, rows that overlap with train, exact ones, pairs, mean coverage.

    Null split ids and sources form groups of their own, shown as "". Rows of role train are left out. Pairs
    are counted from the sizes of classes, never listed.
    """
    sizes = members.where("is_train").groupBy("class").agg(F.count("*").alias("many")).withColumnRenamed("class", "train_class")
    by_class = pairs.join(sizes, "train_class").groupBy(F.col("eval_class").alias("class")).agg(F.max("similarity").alias("similarity"), F.max("eval_coverage").alias("coverage"), F.sum("many").alias("n"))
    best = members.where("not is_train").join(by_class, "class").select(F.col("key").alias(key), "similarity", "coverage", "n")
    role = F.lower(trimmed(F.col("split_role")))
    rows = records.where(role != "train").select(F.col(key), F.coalesce(F.col("split_id"), F.lit("")).alias("split_id"), F.coalesce(clean_id(F.col("source")), F.lit("")).alias("source"))
    joined = rows.join(best, key, "left")
    return joined.groupBy("split_id", "source").agg(
        F.count("*").alias("eval_rows"),
        F.count("n").alias("overlapping_rows"),
        F.count_if(F.col("similarity") == 1.0).alias("identical_sets"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"),
        F.avg("coverage").alias("mean_coverage"),
    )
