"""Queries of the training-data operators over the tables of a data directory, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparlance.llm import copies, garble, language, mixing, overlap, packing, pairs, splits, tokens
from sparlance.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return splits.linked_databases(table(spark, base, "prepared_records"))


def p1_assignment(spark: SparkSession, base: str) -> DataFrame:
    return splits.assign_splits(table(spark, base, "prepared_records"), table(spark, base, "split_targets"))


def p1_split_report(spark: SparkSession, base: str) -> DataFrame:
    return splits.split_report(p1_assignment(spark, base), table(spark, base, "split_targets"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return overlap.pair_keys(overlap.overlapping_pairs(table(spark, base, "prepared_records")))


def p2_overlaps(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of classes; p2_members says which records are in them."""
    return overlap.record_classes_and_pairs(table(spark, base, "prepared_records"))[1]


def p2_members(spark: SparkSession, base: str) -> DataFrame:
    return overlap.overlap_members(*overlap.record_classes_and_pairs(table(spark, base, "prepared_records")))


def p2_report(spark: SparkSession, base: str) -> DataFrame:
    records = table(spark, base, "prepared_records")
    return overlap.overlap_report(records, *overlap.record_classes_and_pairs(records))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return copies.hidden_copies(table(spark, base, "result_rows"))


def p3_statements(spark: SparkSession, base: str) -> DataFrame:
    return copies.distinct_statements(table(spark, base, "result_rows"))


def _all_flagged(spark: SparkSession, base: str) -> DataFrame:
    learned = language.fit_words(table(spark, base, "documents"))
    return pairs.flagged(pairs.all_pairs(table(spark, base, "prepared_records"), table(spark, base, "result_rows")), learned)


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return _all_flagged(spark, base).select("table_name", "row_key", "turn_index", "defect")


def p4_defects(spark: SparkSession, base: str) -> DataFrame:
    """Every defect that a rule finds, one row each; `place` is its place in the order of rules."""
    return _all_flagged(spark, base).selectExpr("table_name", "row_key", "turn_index", "posexplode(all_defects) AS (place, defect)")


def p4_summary(spark: SparkSession, base: str) -> DataFrame:
    return _all_flagged(spark, base).groupBy("table_name", "defect").count().withColumnRenamed("count", "n_pairs")


def p5_containers(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(table(spark, base, "prepared_records"), table(spark, base, "packing_specs"))


def p5_report(spark: SparkSession, base: str) -> DataFrame:
    return packing.packing_report(p5_containers(spark, base), table(spark, base, "packing_specs"))


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.encode_texts(table(spark, base, "documents"))


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix(table(spark, base, "documents"), table(spark, base, "mix_targets"))[0]


def p7_report(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_report(*mixing.mix(table(spark, base, "documents"), table(spark, base, "mix_targets")))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return garble.garbled_documents(table(spark, base, "documents"))


def p8_restored(spark: SparkSession, base: str) -> DataFrame:
    return garble.restored_documents(table(spark, base, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_assignment, p1_split_report, p2_found, p2_overlaps, p2_members, p2_report, p3_found, p3_statements, p4_found, p4_defects, p4_summary,
        p5_containers, p5_report, p6_ids, p7_mix, p7_report, p8_found, p8_restored,
    )
}

ORACLES: dict[str, str] = {
    "p1_found": r"""
        WITH RECURSIVE ids AS (
          SELECT nullif(lower(regexp_replace(dialog_id, '^\s+|\s+$', '', 'g')), '') AS dialog,
                 nullif(lower(regexp_replace(database_id, '^\s+|\s+$', '', 'g')), '') AS db
          FROM prepared_records),
        pairs AS (SELECT DISTINCT dialog, db FROM ids WHERE dialog IS NOT NULL AND db IS NOT NULL),
        links AS (SELECT DISTINCT a.db AS x, b.db AS y FROM pairs a JOIN pairs b USING (dialog) WHERE a.db <> b.db),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT x AS database_a, y AS database_b FROM reach WHERE x < y""",
    "p2_found": r"""
        WITH rows_ AS (
          SELECT record_key AS k, lower(trim(split_role)) = 'train' AS t,
                 regexp_extract_all(lower(array_to_string(list_transform(
                   list_filter(messages, lambda m: m.role IN ('user', 'assistant')), lambda m: coalesce(m.content, '')), chr(10))), '[\p{L}\p{N}]+') AS w
          FROM prepared_records WHERE split_role IS NOT NULL AND messages IS NOT NULL),
        s AS (SELECT k, t, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM rows_ WHERE len(w) >= 3),
        e AS (SELECT k, t, len(g) AS n, unnest(g) AS x FROM s),
        c AS (SELECT a.k AS ka, b.k AS kb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_
              FROM e a JOIN e b ON a.x = b.x WHERE a.t AND NOT b.t GROUP BY a.k, b.k)
        SELECT least(ka, kb) AS key_a, greatest(ka, kb) AS key_b FROM c WHERE 10 * both_ >= 7 * (na + nb - both_)""",
}
