"""Running statements, comparing their results, and scoring."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from sparlance.plans import sqlinfo, sqltree
from sparlance.plans.dialect import statement_of, to_spark

TOLERANCE = 1e-6


@dataclass(frozen=True)
class Score:
    execution_score: float
    normalized_match: bool
    syntax_valid: bool
    error: str | None = None
    strict_execution_score: float | None = None
    value_execution_score: float | None = None
    order_sensitive: bool = False


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    """A query over the session's views: the statement of an answer, from SQLite's dialect.

    Anything but a single SELECT is refused before Spark sees it.
    """
    statement = statement_of(sql)
    sqltree.parse(statement)
    return spark.sql(to_spark(statement))


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (bool, int, float)) else v


def _equal(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=TOLERANCE, abs_tol=TOLERANCE)
    return a == b


def rows_match(reference: list[tuple], generated: list[tuple], ordered: bool) -> bool:
    """Equal rows, duplicates included, by position or (unordered) after sorting by type and spelling of the cells."""
    a, b = ([tuple(map(_cell, r)) for r in rows] for rows in (reference, generated))
    if not ordered:
        spelled = lambda r: tuple(f"{type(v).__name__}:{v!r}" for v in r)
        a.sort(key=spelled)
        b.sort(key=spelled)
    return len(a) == len(b) and all(len(x) == len(y) and all(map(_equal, x, y)) for x, y in zip(a, b))


def _is_number(f: t.StructField) -> bool:
    return isinstance(f.dataType, (t.NumericType, t.BooleanType))


def _shaped(df: DataFrame) -> DataFrame:
    """Columns c0, c1, ...: numbers and booleans as doubles without NaN, all else as text."""
    cols = []
    for i, f in enumerate(df.schema.fields):
        c = df[df.columns[i]] if df.columns.count(f.name) == 1 else F.col(f.name)
        cols.append((F.nanvl(c.cast("double"), F.lit(None).cast("double")) if _is_number(f) else c.cast("string")).alias(f"c{i}"))
    return df.select(*cols)


def compare_unordered(reference: DataFrame, generated: DataFrame) -> DataFrame:
    """(value_match, strict_match, order_sensitive) of two results of any size, without gathering them.

    Rows are grouped by their non-numeric cells and their numbers rounded to the tolerance's scale; groups of
    equal counts match. Groups that differ are compared again by rank within their non-numeric cells, cell by
    cell with the tolerance, so that neighbours on both sides of a rounding edge still match.
    """
    same_labels = reference.columns == generated.columns
    if len(reference.columns) != len(generated.columns):
        return reference.sparkSession.createDataFrame([(False, False, False)], "value_match boolean, strict_match boolean, order_sensitive boolean")
    a, b = reference.toDF(*[f"x{i}" for i in range(len(reference.columns))]), generated.toDF(*[f"x{i}" for i in range(len(generated.columns))])
    kinds = [_is_number(f) and _is_number(g) for f, g in zip(a.schema.fields, b.schema.fields)]
    a, b = _shaped(a), _shaped(b)
    names = a.columns
    texts = [n for n, k in zip(names, kinds) if not k]
    numbers = [n for n, k in zip(names, kinds) if k]
    a, b = (df.select(*[F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("")).alias(n) if n in texts else F.col(n) for n in names]) for df in (a, b))
    rounded = lambda n: F.when(F.col(n).isNull(), "").otherwise(F.format_string("%.4e", F.round(F.col(n), 5) + F.lit(0.0)))
    key = F.xxhash64(*texts, *[rounded(n) for n in numbers]) if names else F.lit(0)

    def sided(df: DataFrame, side: int) -> DataFrame:
        return df.withColumn("_k", key).withColumn("_s", F.lit(side))

    both = sided(a, 1).unionByName(sided(b, -1))
    uneven = both.groupBy("_k").agg(F.sum("_s").alias("_d")).where("_d <> 0").select("_k")
    rest = both.join(uneven, "_k", "left_semi")
    order = Window.partitionBy(*texts, "_s").orderBy(*[F.col(n).asc_nulls_first() for n in numbers]) if numbers else Window.partitionBy(*texts, "_s").orderBy(F.lit(1))
    ranked = rest.withColumn("_r", F.row_number().over(order))
    left = ranked.where("_s = 1").select(*texts, "_r", *[F.col(n).alias(f"l_{n}") for n in numbers], F.lit(1).alias("_l"))
    right = ranked.where("_s = -1").select(*texts, "_r", *[F.col(n).alias(f"r_{n}") for n in numbers], F.lit(1).alias("_rr"))
    zipped = left.join(right, [*texts, "_r"], "full")
    close = lambda n: F.col(f"l_{n}").eqNullSafe(F.col(f"r_{n}")) | F.coalesce(F.abs(F.col(f"l_{n}") - F.col(f"r_{n}")) <= F.greatest(TOLERANCE * F.greatest(F.abs(f"l_{n}"), F.abs(f"r_{n}")), F.lit(TOLERANCE)), F.lit(False))
    bad = F.col("_l").isNull() | F.col("_rr").isNull()
    for n in numbers:
        bad = bad | ~close(n)
    value = zipped.agg((F.count_if(bad) == 0).alias("value_match"))
    return value.select("value_match", (F.col("value_match") & F.lit(same_labels)).alias("strict_match"), F.lit(False).alias("order_sensitive"))


def score_pair(reference_sql: str, generated_sql: str, run: Callable[[str], DataFrame] | None = None) -> Score:
    """Score of one generated statement.

    Without a way to run statements: equality of canonical spellings. With one: the results are compared, by
    position if the reference sorts or limits. An error on either side scores 0 and is reported, the
    statement's syntax counting as valid. Ordered results are gathered for the comparison, as their order
    is part of the result; unordered ones are compared where they are.
    """
    a, b = (sqltree.canonical(sqlinfo.repair_spacing(s)) for s in (reference_sql or "", generated_sql or ""))
    same = a is not None and a == b
    if run is None:
        return Score(float(same), same, b is not None)
    if b is None:
        return Score(0.0, same, False, "generated SQL is not parseable", 0.0, 0.0)
    try:
        left, right = run(reference_sql), run(generated_sql)
        ordered = sqlinfo.is_order_sensitive(reference_sql)
        if ordered:
            value = len(left.columns) == len(right.columns) and rows_match([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()], True)
            strict = value and left.columns == right.columns
        else:
            got = compare_unordered(left, right).first()
            value, strict = got["value_match"], got["strict_match"]
        return Score(float(value), same, True, None, float(strict), float(value), ordered)
    except (PySparkException, ValueError) as e:
        return Score(0.0, same, True, str(e).split("\n")[0][:500], 0.0, 0.0)


def score_dialog(scores: list[Score]) -> dict:
    """Means over the turns of a dialog and whether all turns match; an empty dialog has zeros."""
    if not scores:
        return {"execution_accuracy": 0.0, "syntax_accuracy": 0.0, "interaction_match": 0.0}
    n = len(scores)
    return {
        "execution_accuracy": sum(s.execution_score for s in scores) / n, "syntax_accuracy": sum(s.syntax_valid for s in scores) / n,
        "normalized_accuracy": sum(s.normalized_match for s in scores) / n, "interaction_match": float(all(s.execution_score == 1.0 for s in scores)),
    }


def score_statements(pairs: DataFrame) -> DataFrame:
    """Scores of (reference_sql, generated_sql) columns without a database, in the executors; for any number of rows."""
    from sparlance.functions import text as T

    a, b = T.canonical_sql(F.col("reference_sql")), T.canonical_sql(F.col("generated_sql"))
    spelled = pairs.withColumn("_a", a).withColumn("_b", b)
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return spelled.withColumns({"normalized_match": same, "syntax_valid": F.col("_b").isNotNull(), "execution_score": same.cast("double")}).drop("_a", "_b")


def rescore(results: DataFrame) -> DataFrame:
    """Stored results scored again; the score they had is kept as original_execution_score."""
    return score_statements(results.withColumn("original_execution_score", F.col("execution_score")))
