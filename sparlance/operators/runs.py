"""Comparing runs with each other, row by row and as wholes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ("dialog_id", "turn_index", "database_id", "reference_sql")


def last_per_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key. max_by over structs combines before the shuffle; a hot key is no hot task."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def pairwise(candidate: DataFrame, baseline: DataFrame, *, key: str = "id", order: str = "result_key") -> DataFrame:
    """Counts of fixed, regressed, both correct and both wrong rows on equal ids.

    Of a baseline id that repeats, the last row counts; all candidate rows count; unmatched ones do not.
    """
    ok = F.coalesce(F.col("value_execution_score"), F.lit(0.0)) == 1.0
    b = last_per_id(baseline.select(key, order, ok.alias("b_ok"), F.col("error_primary").alias("b_error")), key, order).drop(order)
    c = candidate.select(key, ok.alias("c_ok"), F.col("error_primary").alias("c_error"))
    j = c.join(b, key)
    return j.select("*", F.when(F.col("c_ok") & ~F.col("b_ok"), "fixed").when(~F.col("c_ok") & F.col("b_ok"), "regressed").when(F.col("c_ok"), "both_correct").otherwise("both_wrong").alias("outcome"))


def pairwise_summary(outcomes: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.agg(F.count("*").alias("samples_compared"), n("fixed").alias("fixed_turns"), n("regressed").alias("regressed_turns"), n("both_correct").alias("both_correct"), n("both_wrong").alias("both_wrong"), (n("fixed") - n("regressed")).alias("net_fixed"))


def pairwise_errors(outcomes: DataFrame) -> DataFrame:
    """(outcome, error_primary, n_rows): the baseline's label of fixed rows, the candidate's of regressed ones."""
    rows = outcomes.where("outcome in ('fixed', 'regressed')").select("outcome", F.when(F.col("outcome") == "fixed", F.col("b_error")).otherwise(F.col("c_error")).alias("error_primary"))
    return rows.groupBy("outcome", "error_primary").agg(F.count("*").alias("n_rows"))


def identity(*columns: str) -> Column:
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


def identity_mismatches(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = IDENTITY) -> DataFrame:
    """(identity columns, n_a, n_b) of the identities that the two sides have a different number of times.

    Grouped and joined by digest; nulls are equal to nulls.
    """
    count = lambda df, n: df.groupBy(identity(*columns).alias("_i"), *columns).agg(F.count("*").alias(n))
    x, y = count(a, "n_a"), count(b, "n_b").select("_i", *[F.col(c).alias(f"_{c}") for c in columns], "n_b")
    j = x.join(y, "_i", "full").fillna(0, ["n_a", "n_b"]).where("n_a <> n_b")
    return j.select(*[F.coalesce(c, F.col(f"_{c}")).alias(c) for c in columns], "n_a", "n_b")


def duplicate_identities(df: DataFrame, columns: tuple[str, ...] = IDENTITY) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def missing_identity(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows in which a part of the identity is null."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.where(bad)


def compare_metrics(treatment: DataFrame, control: DataFrame, names: tuple[str, ...], prefix: str) -> DataFrame:
    """One row: the treatment's metrics, the control's under the prefix, and treatment minus control.

    Both sides are one row; they are put under each other and picked apart by side, without a join.
    """
    both = treatment.withColumn("_side", F.lit("t")).unionByName(control.withColumn("_side", F.lit("c")), allowMissingColumns=True)
    pick = lambda c, side: F.any_value(F.when(F.col("_side") == side, F.col(c)), F.lit(True))
    one = both.agg(*[pick(c, "t").alias(c) for c in treatment.columns], *[pick(n, "c").alias(f"{prefix}_{n}") for n in names])
    return one.select("*", *[(F.col(n) - F.col(f"{prefix}_{n}")).alias(f"{n}_delta_vs_{prefix}") for n in names])


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n_rows): for each rule, how many rows break it, in one pass; rules with none are listed with 0."""
    counted = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n_rows")) for i, name in enumerate(rules)])).alias("v")).select("v.*")


def context_gap(local_normal: DataFrame, local_treated: DataFrame, other_normal: DataFrame, other_treated: DataFrame, metric: str) -> DataFrame:
    """Four one-row frames: the gap between two systems without and with a treatment, and how it moved."""
    sides = {"ln": local_normal, "lt": local_treated, "on": other_normal, "ot": other_treated}
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("_side"), F.col(metric).alias("_v")) for n, df in sides.items()])
    j = rows.agg(*[F.max(F.when(F.col("_side") == n, F.col("_v"))).alias(n) for n in sides])
    return j.select((F.col("on") - F.col("ln")).alias("normal_gap"), (F.col("ot") - F.col("lt")).alias("treated_gap"), (F.col("ot") - F.col("lt") - F.col("on") + F.col("ln")).alias("gap_delta"), (F.col("lt") - F.col("ln")).alias("local_delta"), (F.col("ot") - F.col("on")).alias("other_delta"))




def failure_analysis(candidate: DataFrame, baseline: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Classified runs, their pivots, label summaries and method hints, and the pairwise outcome.

    Both runs must hold the same rows; ValueError if an identity differs in number.
    """
    from sparlance.operators import classify, rollups

    if identity_mismatches(candidate, baseline, (key,)).limit(1).count():
        raise ValueError("the runs hold different rows")
    c, b = classify.classify(candidate), classify.classify(baseline)
    both = c.unionByName(b)
    return {"pivot": rollups.error_pivot(both), "labels": classify.error_summary(both), "hints": classify.method_hints(c), "outcomes": pairwise(c, b, key=key)}
