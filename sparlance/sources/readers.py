"""Sources: JSON lines, JSON documents, results of many files, benchmarks, tables of a catalog, JDBC, fixtures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
#: Declared schemas of the artifact files.
RECORD_SCHEMA = f"id string, dialog_id string, messages {MESSAGES}, source string, database_id string, history_policy string, evaluation_mode string, split_id string, split_role string, split_row_id string"
RESULT_SCHEMA = "id string, dialog_id string, turn_index int, model_name string, prompt_variant string, source string, execution_score double, strict_execution_score double, value_execution_score double, syntax_valid boolean, generation_latency_ms double, reference_sql string, generated_sql string, score_error string"


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, and strict reading fails on a broken line."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document, or an array of records, over several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def result_files(spark: SparkSession, patterns: Iterable[str], schema: str = RESULT_SCHEMA) -> DataFrame:
    """Result rows of all files that the patterns match, each file once, with `result_file`; ValueError for no file."""
    jvm = spark.sparkContext._jvm
    paths = set()
    for p in patterns:
        where = jvm.org.apache.hadoop.fs.Path(p)
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        paths |= {f.getPath().toString() for f in found or []}
    if not paths:
        raise ValueError("no result file")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return json_lines(spark, sorted(paths), schema).select("*", name.alias("result_file"))


def benchmark(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Records of one of three layouts under one schema: prepared, sparc (flat questions), bird (with evidence)."""
    if kind == "prepared":
        return json_lines(spark, path, RECORD_SCHEMA)
    if kind == "sparc":
        return json_document(spark, path).select(F.coalesce("database_id", "db_id").alias("database_id"), "question", F.col("query").alias("reference_sql"), F.lit(None).cast("string").alias("evidence"))
    if kind == "bird":
        return json_document(spark, path).select(F.col("db_id").alias("database_id"), "question", F.col("SQL").alias("reference_sql"), "evidence")
    raise ValueError(f"unknown benchmark {kind!r}")


def catalog_columns(spark: SparkSession) -> DataFrame:
    """(table, position, column, type) of the session's tables and views; catalog metadata, a few rows per table."""
    rows = [(t.name, i, c.name, c.dataType) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "`table` string, position int, `column` string, type string")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query against a database with a JDBC driver on the class path; the database runs the query."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def registry(spark: SparkSession, rows: list[dict], required: tuple[str, ...]) -> DataFrame:
    """A short list of configuration rows as a frame; ValueError for a missing or blank required field."""
    for r in rows:
        lacking = [k for k in required if not str(r.get(k) or "").strip()]
        if lacking:
            raise ValueError(f"missing {', '.join(lacking)}")
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def yaml_registry(spark: SparkSession, path: str, section: str, required: tuple[str, ...]) -> DataFrame:
    """A section of a YAML file as a frame; needs a YAML library."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("no YAML library is installed") from e
    with open(path, encoding="utf-8") as f:
        return registry(spark, yaml.safe_load(f)[section], required)


def rental_fixture(spark: SparkSession) -> dict[str, DataFrame]:
    """Boats let by the day: a let is offered twice under one promotion, the trap of sums over a bridge table."""
    harbours = [(10, "Old Pier", "west"), (11, "Sandbar", "west"), (12, "Lighthouse", "east")]
    lets = [(501, 10, 310.0, 4, "2025-06-14"), (502, 11, 90.0, 1, "2025-07-02"), (503, 12, 745.5, 9, "2024-09-20"), (504, 10, 55.25, 1, "2024-05-01")]
    return {
        "harbours": spark.createDataFrame(harbours, "id long, title string, coast string"),
        "lets": spark.createDataFrame(lets, "id long, harbour_id long, fee double, days int, since string"),
        "promotions": spark.createDataFrame([(1, "Early tide"), (2, "Late summer")], "id long, slogan string"),
        "offers": spark.createDataFrame([(501, 1, "poster"), (501, 1, "radio"), (502, 1, "poster"), (503, 2, "radio")], "let_id long, promotion_id long, medium string"),
    }


def rounded_rows(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, for comparison with written-down rows."""
    return df.select(*[F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])
