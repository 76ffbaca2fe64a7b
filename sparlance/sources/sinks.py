"""Sinks: JSON lines, CSV with a fixed header, small JSON artifacts, and manifests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, one_file: bool = False, sort: bool = True) -> None:
    """JSON lines, keys in order; one_file only for artifacts that fit a task."""
    out = df.select(*sorted(df.columns)) if sort else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with these columns in this order; arrays as JSON."""
    kinds = dict(df.dtypes)
    df.select(*[F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def write_json(value: object, path: str) -> None:
    """A small artifact, sorted and indented."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def content_digest(df: DataFrame) -> str:
    """Order-free digest of a frame's rows with their multiplicity, from fixed-size partial sums."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    got = df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b")).agg(F.count("*"), F.expr("bit_xor(a)"), F.sum(F.pmod("a", F.lit(1 << 40))), F.expr("bit_xor(b)"), F.sum(F.pmod("b", F.lit(1 << 40)))).first()
    import hashlib

    return hashlib.sha256(":".join(map(str, got)).encode()).hexdigest()


def manifest(run_id: str, model: str, source: DataFrame, output: DataFrame, metrics: dict, command: list[str], commit: str | None = None) -> dict:
    """What a run read and wrote: digests, row count, metrics, command."""
    return {"schema_version": 1, "run_id": run_id, "model_name": model, "input_sha256": content_digest(source), "output_sha256": content_digest(output), "row_count": output.count(), "metrics": metrics, "command": command, "git_commit": commit}
