"""Failure labels of generated statements, diagnostics, and scorers of columns and values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparlance.functions import text as T
from sparlance.plans import sqlinfo

# Labels in the order in which they are reported, and in which the primary one is chosen.
LABELS = ("correct", "invalid_sql", "execution_error", "schema_link", "join_path", "aggregation", "grain_fanout", "history_resolution", "ordering_limit", "value_grounding", "projection", "other")
PRIORITY = ("invalid_sql", "execution_error", "schema_link", "join_path", "aggregation", "grain_fanout", "ordering_limit", "value_grounding", "history_resolution", "projection", "other")
STRUCTURAL = ("schema_link", "join_path", "aggregation", "grain_fanout", "value_grounding")
# The method that a label hints at.
HINTS = {
    "schema_link": ("planner_schema_linking",), "join_path": ("planner_schema_linking",), "aggregation": ("planner_schema_linking", "metric_definitions"),
    "grain_fanout": ("planner_schema_linking", "metric_definitions"), "projection": ("planner_schema_linking",), "value_grounding": ("semantic_value_grounding",),
    "invalid_sql": ("recovery",), "execution_error": ("recovery",), "history_resolution": ("recovery",), "ordering_limit": ("planner_schema_linking",), "other": ("unresolved_other",),
}


def with_features(results: DataFrame) -> DataFrame:
    """Adds `ref` and `gen`, the features of both statements (null fields if not parsable)."""
    return results.withColumn("ref", T.sql_features(F.col("reference_sql"))).withColumn("gen", T.sql_features(F.col("generated_sql")))


def classify(results: DataFrame) -> DataFrame:
    """Adds error_primary, error_secondary and error_secondary_text.

    correct: the value score, or without one the execution score, is 1. Else invalid_sql and execution_error
    by the stored flags, then labels by comparing features. join_path needs equal tables, projection equal
    aggregates; a structural label in a later turn adds history_resolution; no label at all is other.
    """
    df = with_features(results)
    r, g = F.col("ref"), F.col("gen")
    differ = lambda *fields: ~_all_equal(r, g, fields)
    tables, agg = differ("tables"), differ("aggregations")
    some_distinct = F.coalesce(r["distinct"], F.lit(False)) | F.coalesce(g["distinct"], F.lit(False))
    tests = {
        "schema_link": tables,
        "join_path": ~tables & differ("join_tables", "join_conditions"),
        "aggregation": agg,
        "grain_fanout": differ("group_by", "distinct") | (some_distinct & differ("columns")),
        "ordering_limit": differ("order_sql", "limit_sql"),
        "value_grounding": differ("where_sql", "having_sql", "literals"),
        "projection": ~agg & differ("projections", "projection_order"),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    late = (F.coalesce(F.col("turn_index"), F.lit(0)) > 0) & F.arrays_overlap(found, F.array(*map(F.lit, STRUCTURAL)))
    found = F.concat(found, F.when(late, F.array(F.lit("history_resolution"))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_l", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other"))))
    best = F.get(F.array_intersect(F.array(*map(F.lit, PRIORITY)), "_l"), 0)
    primary = (
        F.when(F.coalesce("value_execution_score", "execution_score") == 1.0, "correct")
        .when(~F.coalesce("syntax_valid", F.lit(True)), "invalid_sql")
        .when(F.coalesce("score_error", F.lit("")) != "", "execution_error")
        .when(g["tables"].isNull(), "invalid_sql")
        .when(r["tables"].isNull(), "other")
        .otherwise(best)
    )
    plain = primary.isin("correct", "invalid_sql", "execution_error") | g["tables"].isNull() | r["tables"].isNull()
    df = df.withColumn("error_primary", primary).withColumn("error_secondary", F.when(plain, F.array().cast("array<string>")).otherwise(F.array_except("_l", F.array("error_primary"))))
    return df.withColumn("error_secondary_text", F.array_join("error_secondary", ",")).drop("_l")


def _all_equal(r: Column, g: Column, fields: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & r[f].eqNullSafe(g[f])
    return out


def diagnostics(classified: DataFrame) -> DataFrame:
    """Adds missing and extra tables and columns of the generated statement, and how many differ."""
    df = classified
    empty = F.array().cast("array<string>")
    for what in ("tables", "columns"):
        a, b = F.coalesce(F.col("ref")[what], empty), F.coalesce(F.col("gen")[what], empty)
        one = what[:-1]
        df = df.withColumn(f"missing_{what}", F.array_except(a, b)).withColumn(f"extra_{what}", F.array_except(b, a))
        df = df.withColumn(f"{one}_diff_count", F.size(f"missing_{what}") + F.size(f"extra_{what}"))
    return df


def error_summary(classified: DataFrame) -> DataFrame:
    """Per (model, variant, label): count, share in its (model, variant), and mean scores within the label.

    A null variant is "". Labels without rows do not appear. Two small groupings, joined on the run.
    """
    rows = classified.select("model_name", F.coalesce("prompt_variant", F.lit("")).alias("prompt_variant"), "error_primary", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("value_execution_score", "strict_execution_score")], F.col("syntax_valid").cast("double").alias("s"))
    by_label = rows.groupBy("model_name", "prompt_variant", "error_primary").agg(F.count("*").alias("n"), F.avg("value_execution_score").alias("value_accuracy"), F.avg("strict_execution_score").alias("strict_accuracy"), F.avg("s").alias("syntax_accuracy"))
    from pyspark.sql import Window

    return by_label.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("model_name", "prompt_variant")))


def method_hints(classified: DataFrame) -> DataFrame:
    """(method, n_rows) over the primary labels but correct."""
    hints = F.create_map(*[x for k, v in HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    counted = classified.where("error_primary <> 'correct'").groupBy("error_primary").agg(F.count("*").alias("n"))
    return counted.select(F.explode(F.element_at(hints, F.col("error_primary"))).alias("method"), "n").groupBy("method").agg(F.sum("n").alias("n_rows"))


def validated(results: DataFrame, sql: str = "generated_sql") -> DataFrame:
    """Adds `check`: the statement against the schema that its prompt shows."""
    user = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"]), "\n")
    return results.withColumn("check", T.schema_check(F.col(sql), user))


def column_validity(outputs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Outputs (dialog_id, generated_sql, ...) with inputs (dialog_id, allowed map, patterns): three verdicts per row.

    Unresolved qualifiers, references outside the allowed columns, and patterns that must not occur.
    """

    def check(sqls: pd.Series, maps: pd.Series) -> pd.DataFrame:
        got = [sqlinfo.column_references(s, {k: set(v) for k, v in (m.items() if isinstance(m, dict) else m)}) for s, m in zip(sqls, maps)]
        return pd.DataFrame(got, columns=["parsed", "invalid", "unresolved"])

    df = outputs.join(allowed, "dialog_id").withColumn("refs", F.pandas_udf(check, sqlinfo.REFERENCES_SCHEMA)("generated_sql", "allowed"))
    hit = F.filter("patterns", lambda p: F.contains(F.lower("generated_sql"), F.lower(p)))
    ok = F.col("refs.parsed") & (F.size("refs.invalid") == 0)
    return df.withColumns({"matched_patterns": hit, "alias_resolution_success": F.col("refs.parsed") & (F.size("refs.unresolved") == 0), "schema_valid_sql": ok, "column_validity_match": ok & (F.size(hit) == 0)})


def value_choice(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """Outputs (dialog_id, generated_sql) with expectations (dialog_id, table, column, storage_value): the value the
    statement selects and whether it is the expected one."""
    pick = lambda s, t, c: pd.Series([sqlinfo.selected_value(x, y, z) for x, y, z in zip(s, t, c)], dtype=object)

    def run(s: pd.Series, t: pd.Series, c: pd.Series) -> pd.Series:
        return pick(s, t, c)

    df = outputs.join(expected, "dialog_id").withColumn("selected_value", F.pandas_udf(run, "string")("generated_sql", "table", "column"))
    return df.withColumn("value_choice_match", F.col("selected_value").eqNullSafe(F.col("storage_value")))
