"""Problem 7: mixing sources to target weights.

Each source owes target_share of a fixed total of tokens, at most max_repeats times its own
tokens. Its documents are shuffled by hash, anew in each repetition, laid end to end, and cut
into blocks of equal tokens. Golden-ratio points, mapped through the cumulative shares, say
which source fills which slot; a source's k-th slot takes its k-th block, so any stretch of
the mix has close to the target shares.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparlance.llm.tokens import token_counts
from sparlance.operators.ranking import hashed_running, ordered_rank
from sparlance.session import cut

BLOCK_TOKENS = 16_384
#: Cells of the unit interval by which points meet the ranges of sources.
CELLS = 1024
GOLDEN = (math.sqrt(5) - 1) / 2


def source_quotas(available: DataFrame, targets: DataFrame) -> list[dict]:
    """Per listed source, in order of name: tokens it has, owes (quota) and the repetitions that takes.

    One row per listed source comes to the driver. Null or negative shares and repeats count as 0,
    a source that is listed twice gets its shares added and its larger cap.
    """
    listed = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = listed.join(available, "source", "left").orderBy("source").collect()
    total = sum(r["tokens"] or 0 for r in rows)
    out = []
    for r in rows:
        tokens, cap = int(r["tokens"] or 0), max(0, int(r["repeats"] or 0))
        quota = min(round(max(0.0, float(r["share"] or 0)) * total), cap * tokens)
        out.append({"source": r["source"], "share": float(r["share"] or 0), "cap": cap, "tokens": tokens, "quota": quota, "epochs": min(cap, -(-quota // tokens)) if tokens else 0, "total": total})
    return out


def _slots(spark, quotas: list[dict], block: int) -> DataFrame:
    """(source, block, slot): the slot of each block of a source; there are as many slots as blocks, each taken once.

    Golden-ratio points map the slots through the cumulative weights to sources, and a source's k-th slot takes
    its k-th block. By the low discrepancy of the points a source gets a few slots more or fewer than it has blocks, in
    the order of the logarithm of the slots: surplus slots, in order, take the blocks that are left, in order.
    """
    counts = {q["source"]: -(-q["quota"] // block) for q in quotas if q["quota"]}
    total = sum(counts.values())
    bounds, low = [], 0
    for source, n in sorted(counts.items()):
        bounds.append((source, low / total, (low + n) / total if low + n < total else 2.0, n))
        low += n
    ranges = spark.createDataFrame(bounds, "source string, low double, high double, blocks long")  # one row for each listed source
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.least("high", F.lit(1.0)) * CELLS))))  # at most CELLS and two for each source
    drawn = spark.range(total).withColumnRenamed("id", "slot").withColumn("point", (F.col("slot") + 1) * F.lit(GOLDEN) % 1.0).withColumn("cell", F.floor(F.col("point") * CELLS))
    drawn = drawn.join(F.broadcast(cells), "cell").where("point >= low and point < high").select("source", "slot", "blocks")
    ranked = cut(ordered_rank(drawn, "source", "slot", out="block"))
    taken = ranked.where("block < blocks").select("source", "block", "slot")
    got = ranked.groupBy("source").agg(F.count("*").alias("n"))
    short = ranges.join(got, "source", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks")
    few = lambda df, *order: df.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # noqa: E731  a few for each source
    left = few(short.select("source", F.explode(F.sequence(F.col("n"), F.col("blocks") - 1)).alias("block")), "block", "source")
    free = few(ranked.where("block >= blocks").select("slot"), "slot")
    return taken.unionByName(left.join(free, "k").select("source", "block", "slot"))


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, block: int = BLOCK_TOKENS, seed: int = 7) -> tuple[DataFrame, list[dict]]:
    """The mix, (slot, at, source, epoch, key, n_tokens), one row per drawn document, and the quotas.

    slot orders the blocks, at the documents in a block. Documents of sources that are not listed, and
    of a null source, are never drawn. A document is drawn whole; the last one of a source is drawn if
    at least half of it lies within the quota, so a source misses its quota by half a document at most.
    Null and empty texts have 0 tokens and are drawn along with their neighbours. A source without
    documents, or with a cap of 0, contributes nothing; no share is moved to other sources. No row,
    no listed source: an empty mix.
    """
    spark = docs.sparkSession
    listed = docs.join(F.broadcast(targets.where("source is not null").select("source").distinct()), "source")
    sized = token_counts(listed.select(key, text), key=key, text=text, vocabulary=vocabulary)
    sized = cut(sized.join(listed.select(key, "source").distinct(), key))
    quotas = source_quotas(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), targets)
    wanted = spark.createDataFrame([(q["source"], q["tokens"], q["quota"], q["epochs"]) for q in quotas if q["epochs"]], "source string, tokens long, quota long, epochs int")
    each = sized.join(F.broadcast(wanted), "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    shuffled = hashed_running(each.withColumn("order", F.xxhash64("epoch", key)), ["source", "epoch"], ["order", key], amount=F.col("n_tokens"), seed=seed, out="at")
    placed = shuffled.withColumn("at", F.col("at") + F.col("epoch") * F.col("tokens"))
    drawn = placed.where(2 * F.col("at") + F.col("n_tokens") <= 2 * F.col("quota")).withColumn("block", F.least(F.floor(F.col("at") / block), F.ceil(F.col("quota") / block) - 1))
    joined = drawn.join(_slots(spark, quotas, block), ["source", "block"])
    return joined.select("slot", "at", "source", "epoch", key, "n_tokens"), quotas


def mix_report(mixed: DataFrame, quotas: list[dict]) -> DataFrame:
    """Per listed source: target and actual share of the total, tokens it has and gave, documents drawn, repetitions."""
    spark = mixed.sparkSession
    rows = [(q["source"], q["share"], q["cap"], q["tokens"], q["quota"], q["total"]) for q in quotas]
    base = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long, quota_tokens long, total_tokens long")
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count("*").alias("drawn_docs"), (F.max("epoch") + 1).alias("repeats"))
    full = base.join(got, "source", "left").fillna(0, ["drawn_tokens", "drawn_docs", "repeats"])
    return full.withColumn("actual_share", F.col("drawn_tokens") / F.greatest("total_tokens", F.lit(1)))
