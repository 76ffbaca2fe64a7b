"""Roll-ups of results: per run, per group, per dialog, per label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparlance.functions import text as T
from sparlance.operators.classify import LABELS


def _or_execution(c: str) -> Column:
    return F.coalesce(F.col(c), F.col("execution_score"))


def run_metrics(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means per run. Strict and value scores fall back to the execution score row by row; a null latency is 0."""
    return results.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.avg("execution_score").alias("execution_accuracy"), F.avg(_or_execution("strict_execution_score")).alias("strict_execution_accuracy"),
        F.avg(_or_execution("value_execution_score")).alias("value_execution_accuracy"), F.avg(F.coalesce(F.col("syntax_valid"), F.lit(False)).cast("double")).alias("syntax_accuracy"),
        F.avg(F.coalesce("generation_latency_ms", F.lit(0.0))).alias("mean_generation_latency_ms"),
    )


def histogram(df: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    """(value, n_rows); a null is counted under `default`."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(default)).alias("value")).agg(F.count("*").alias("n_rows"))


def interaction_match(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of dialogs all of whose turns score 1. Rows without a dialog are left out of the share, but count as
    one dialog in dialog_count. Two levels, so a long dialog is combined before the shuffle."""
    per = results.groupBy(*by, "dialog_id").agg(F.bool_and(F.col("execution_score") == 1.0).alias("all_match"))
    named = F.col("dialog_id").isNotNull()
    return per.groupBy(*by).agg(F.count("*").alias("dialog_count"), F.coalesce(F.avg(F.when(named, F.coalesce(F.col("all_match"), F.lit(False)).cast("double"))), F.lit(0.0)).alias("interaction_match_rate"))


def split_integrity(results: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group: distinct split rows in order of first sight, and a digest of the list.

    A digest of an ordered list needs the list, one id per split row, in one task; it is meant for a run's
    own rows. For whole corpora `set_digest` gives an order-free digest instead.
    """
    rows = results.where("split_row_id is not null")
    first = rows.groupBy(*by, "split_row_id").agg(F.min(order).alias("_p"), F.count("*").alias("n"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_p", "split_row_id"))), lambda x: x["split_row_id"])
    return first.groupBy(*by).agg(F.count("*").alias("split_row_count"), F.sum("n").alias("split_eval_turn_count"), T.list_digest(ids).alias("split_row_ids_sha256"))


def set_digest(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Order-free digest of a column's values with their multiplicity: fixed-size partial sums, any number of rows."""
    h = F.xxhash64(F.col(column).cast("string"))
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.expr(f"bit_xor(xxhash64(cast({column} as string)))").alias("digest_xor"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("digest_sum"))


def token_rollup(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Token totals and means over the rows with a total; missing parts count as 0."""
    rows = results.withColumn("_t", T.token_usage(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens"))).where("_t is not null")
    p, c = (F.coalesce(F.col(x), F.lit(0)) for x in ("prompt_tokens", "completion_tokens"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows_with_usage"), F.sum(p).alias("total_prompt_tokens"), F.sum(c).alias("total_completion_tokens"), F.sum("_t").alias("total_tokens"),
        F.avg(p).alias("mean_prompt_tokens"), F.avg(c).alias("mean_completion_tokens"), F.avg("_t").alias("mean_total_tokens"),
    )


def _variant() -> Column:
    return F.coalesce("prompt_variant", F.lit("")).alias("prompt_variant")


def _scores(results: DataFrame) -> DataFrame:
    """Columns that a whole frame lacks fall back to the execution score; nulls in them stay nulls."""
    for c in ("strict_execution_score", "value_execution_score"):
        if c not in results.columns:
            results = results.withColumn(c, F.col("execution_score"))
    return results


def group_summary(results: DataFrame) -> DataFrame:
    """Per (model, variant, source), null groups kept: means that skip nulls, and rows with a score."""
    return _scores(results).groupBy("model_name", _variant(), "source").agg(
        F.avg("execution_score").alias("accuracy"), F.avg("strict_execution_score").alias("strict_accuracy"), F.avg("value_execution_score").alias("value_accuracy"),
        F.avg(F.col("syntax_valid").cast("double")).alias("syntax_accuracy"), F.avg("generation_latency_ms").alias("mean_latency_ms"), F.count("execution_score").alias("samples"),
    )


def dialog_summary(results: DataFrame) -> DataFrame:
    """Means per dialog, then means of these per (model, variant, source), with the share of dialogs that match throughout."""
    per = _scores(results).groupBy("model_name", _variant(), "source", "dialog_id").agg(
        F.avg("execution_score").alias("e"), F.avg("strict_execution_score").alias("s"), F.avg("value_execution_score").alias("v"), F.avg(F.col("syntax_valid").cast("double")).alias("y"),
        F.min(F.when(F.col("execution_score") == 1.0, 1).otherwise(0)).alias("m"), F.count("execution_score").alias("t"),
    )
    return per.groupBy("model_name", "prompt_variant", "source").agg(
        F.avg("e").alias("dialog_execution_accuracy"), F.avg("s").alias("dialog_strict_accuracy"), F.avg("v").alias("dialog_value_accuracy"), F.avg("y").alias("dialog_syntax_accuracy"),
        F.avg("m").alias("interaction_match_rate"), F.count("dialog_id").alias("dialogs"), F.sum("t").alias("turns"),
    )


def run_label() -> Column:
    """model[variant], or the model alone."""
    v = F.coalesce("prompt_variant", F.lit(""))
    return F.when(v != "", F.concat("model_name", F.lit("["), v, F.lit("]"))).otherwise(F.col("model_name"))


def error_pivot(classified: DataFrame) -> DataFrame:
    """Per run: counts of all labels in columns, accuracies, and turns with history_resolution anywhere.

    A null score counts 0; a value score of 0 stays 0.
    """
    z = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0)))
    history = (F.col("error_primary") == "history_resolution") | F.array_contains("error_secondary", "history_resolution")
    return classified.groupBy(run_label().alias("run")).agg(
        F.count("*").alias("samples"), z("value_execution_score").alias("value_accuracy"), z("strict_execution_score").alias("strict_accuracy"),
        F.avg(F.col("syntax_valid").cast("double")).alias("syntax_accuracy"), *[F.count_if(F.col("error_primary") == x).alias(x) for x in LABELS], F.count_if(history).alias("history_resolution_turns"),
    )


def leaderboard(results: DataFrame) -> DataFrame:
    """Variants by (accuracy, syntax rate), best first, with a rank; ties by name."""
    per = results.groupBy(_variant()).agg(F.avg("execution_score").alias("accuracy"), F.avg(F.col("syntax_valid").cast("double")).alias("syntax_rate"), F.avg(F.coalesce("generation_latency_ms", F.lit(0.0))).alias("mean_latency_ms"), F.count("*").alias("samples"))
    return per.orderBy(F.desc("accuracy"), F.desc("syntax_rate"), "prompt_variant")


def composition(records: DataFrame) -> DataFrame:
    """Totals of a prepared dataset by source."""
    return records.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n_records"), F.coalesce(F.sum("assistant_turn_count"), F.lit(0)).alias("turns"), F.coalesce(F.max("assistant_turn_count"), F.lit(0)).alias("max_turns"), F.count_if(F.col("turn_format") == "multi_turn_dialog").alias("multi_turn"))


def element_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n_rows): in how many rows each element of an array column occurs."""
    return df.select(F.explode(F.array_distinct(F.col(column))).alias("value")).groupBy("value").agg(F.count("*").alias("n_rows"))


def evidence(df: DataFrame, metrics: str, allowed: tuple[str, ...], outputs: str, n: int = 3) -> DataFrame:
    """The allowed entries of a metrics map, and the first n outputs of each arm."""
    return df.withColumn(metrics, F.map_filter(metrics, lambda k, _: k.isin(*allowed))).withColumn(outputs, F.slice(outputs, 1, n))


def metric_rollup(rows: DataFrame) -> DataFrame:
    """Roll-up of scored metric queries; execution accuracy over rows with a database, not attempted ones as 0."""
    backed = F.col("database_path").isNotNull()
    return rows.agg(
        F.count("*").alias("n_rows"), F.avg(F.col("parse_success").cast("double")).alias("parse_rate"), F.avg(F.col("compile_success").cast("double")).alias("compile_rate"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("measure_f1", "dimension_f1", "filter_f1", "measure_preservation")],
        F.avg(F.when(backed, F.coalesce("execution_score", F.lit(0.0)))).alias("execution_accuracy"),
    )
