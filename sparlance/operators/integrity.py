"""Splits, manifests, leakage between row sets, and registry checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparlance.functions import text as T

# Roles a split can have.
ROLES = ("train", "validation", "proxy_dev_seen", "clean_local_holdout", "external_target")


def split_row_ids(dialogs: DataFrame, *, index: str, split: str, database: str = "database_id", prefix: str = "dialogs") -> DataFrame:
    """Adds split_row_id `<prefix>_<split>:<four-digit index>:<database>`."""
    return dialogs.withColumn("split_row_id", F.concat(F.lit(f"{prefix}_{split}:"), F.lpad(F.col(index).cast("string"), 4, "0"), F.lit(":"), F.coalesce(F.col(database), F.lit(""))))


def select_range(dialogs: DataFrame, index: str, start: int, end: int) -> DataFrame:
    """Rows with start <= index < end; ValueError for a range that is none."""
    if start < 0 or end < start:
        raise ValueError(f"selection range {start}:{end}")
    return dialogs.where((F.col(index) >= start) & (F.col(index) < end))


def split_manifest(selected: DataFrame, order: str) -> DataFrame:
    """One row: number of rows, databases, turns, and the digest of the ordered id list."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order, "split_row_id"))), lambda x: x["split_row_id"])
    return selected.agg(F.count("*").alias("n_rows"), F.count_distinct("database_id").alias("n_databases"), F.coalesce(F.sum("assistant_turn_count"), F.lit(0)).alias("turn_count"), T.list_digest(ids).alias("row_ids_sha256"))


def stamp(records: DataFrame, manifest: dict) -> DataFrame:
    """Records with their split's id, role, source path and source digest."""
    return records.withColumns({k: F.lit(manifest[v]) for k, v in (("split_id", "split_id"), ("split_role", "role"), ("split_source_path", "source_path"), ("split_source_sha256", "source_sha256"))})


def check_manifests(manifests: DataFrame) -> DataFrame:
    """(split_id, problem) of manifests with a wrong version, an empty text, or an unknown role or status."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    tests = [(f"missing {c}", blank(c)) for c in ("split_id", "dataset", "source_path", "source_sha256", "source_split", "leakage_boundary")]
    tests += [("schema_version", ~F.col("schema_version").eqNullSafe(F.lit(1))), ("unknown role", ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))), ("status not ready", ~F.coalesce(F.col("status") == "ready", F.lit(False)))]
    return manifests.select("split_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))).alias("problem"))


def shared_rows(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that occur on both sides; a semi-join on distinct keys."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def unstamped(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """(split_id, split_role, n_rows) of stamped records that disagree with their manifest, or have none."""
    m = manifests.select("split_id", F.col("role").alias("m_role"), F.col("source_sha256").alias("m_sha"))
    j = records.where("split_id is not null").join(m, "split_id", "left")
    bad = F.col("m_role").isNull() | ~F.col("m_role").eqNullSafe(F.lower(F.trim("split_role"))) | ~F.col("m_sha").eqNullSafe(F.col("split_source_sha256"))
    return j.where(bad).groupBy("split_id", F.coalesce("split_role", F.lit("")).alias("split_role")).agg(F.count("*").alias("n_rows"))


def missing_databases(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """Database ids of records, trimmed and in lower case, that the schemas lack."""
    ids = records.select(F.lower(F.trim("database_id")).alias("database_id")).where("database_id <> ''").distinct()
    return ids.join(schemas.select(F.lower("db_id").alias("database_id")), "database_id", "left_anti")


def registry_problems(experiments: DataFrame) -> DataFrame:
    """(experiment_id, problem): repeated ids, unknown, own or absent controls, unknown roles."""
    ids = experiments.groupBy("experiment_id").agg(F.count("*").alias("n"))
    known = ids.select(F.col("experiment_id").alias("control_experiment_id"), F.lit(True).alias("known"))
    e = experiments.join(ids, "experiment_id").join(known, "control_experiment_id", "left")
    c = F.coalesce(F.col("control_experiment_id"), F.lit(""))
    tests: list[tuple[str, Column]] = [
        ("duplicate id", F.col("n") > 1), ("control missing", (F.col("method") != "direct_sql") & (c == "")), ("control is itself", c == F.col("experiment_id")),
        ("unknown control", (c != "") & F.col("known").isNull()), ("unknown role", ~F.coalesce(F.col("dataset_role").isin(*ROLES), F.lit(False))),
    ]
    return e.select("experiment_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))).alias("problem")).distinct()
