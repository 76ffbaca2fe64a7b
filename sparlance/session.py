"""Session defaults, table access, and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "prepared_records result_rows database_schemas split_manifests split_targets "
    "packing_specs mix_targets"
).split()


def build_session(master: str = "local[*]", **conf: object) -> SparkSession:
    """A session with the settings the engine expects: UTC, AQE with skew handling, Arrow."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master.startswith("local["):
        settings |= {"spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1"}
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    spark = SparkSession.builder.master(master).appName("sparlance").config(map=settings).getOrCreate()
    let_workers_import(spark)
    return spark


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder that holds this package on the path of Python workers that start from now on.

    For workers that see the same folders as the driver, whatever their working directory; elsewhere the
    package is shipped with --py-files or installed.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    let_workers_import(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def register(spark: SparkSession, base: str, names: list[str] | None = None) -> None:
    """Temp views over the parquet tables, for SQL text that names them."""
    for name in names or TABLES:
        if Path(f"{base}/{name}.parquet").exists() or "://" in base:
            table(spark, base, name).createOrReplaceTempView(name)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; a folder of our own only where none is set and all of Spark runs in one process.

    On a cluster a folder of this machine would be lost to the others, so there the setting is needed.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sparlance-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that a lost executor costs no rerun.

    Spark removes the files when the result is no longer used, with spark.cleaner.referenceTracking.cleanCheckpoints,
    which build_session sets.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
