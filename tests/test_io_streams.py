import json

import pytest

from sparlance.operators.ranking import hashed_running, ordered_rank
from sparlance.sources import readers, sinks
from sparlance.streaming.rollout import stream_rollout, windowed_counts


def test_json_round_trip_and_results(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, execution_score double")
    sinks.write_json_lines(df, f"{tmp_path}/run1")
    sinks.write_json_lines(df.limit(1), f"{tmp_path}/run2", one_file=True)
    back = readers.json_lines(spark, f"{tmp_path}/run1", "id string, execution_score double")
    assert sinks.content_digest(back) == sinks.content_digest(df) != sinks.content_digest(df.union(df))
    got = readers.result_files(spark, [f"{tmp_path}/run*/*.json", f"{tmp_path}/run1/*.json"])
    assert got.count() == 3 and got.where("result_file is null").count() == 0
    with pytest.raises(ValueError):
        readers.result_files(spark, [f"{tmp_path}/none*"])


def test_documents_csv_and_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"db_id": "d", "question": "q", "SQL": "s", "evidence": "e"}, {"db_id": "d", "question": "q2", "SQL": "s2", "evidence": None}], indent=1))
    assert readers.json_document(spark, f"{tmp_path}/a.json").count() == 2
    assert readers.benchmark(spark, "bird", f"{tmp_path}/a.json").columns == ["database_id", "question", "reference_sql", "evidence"]
    with pytest.raises(ValueError):
        readers.benchmark(spark, "other", "x")
    (tmp_path / "l.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert readers.json_lines(spark, f"{tmp_path}/l.jsonl", "id string").count() == 2
    df = spark.createDataFrame([("a", ["x", "y"])], "id string, tags array<string>")
    sinks.write_csv(df, f"{tmp_path}/c", ["tags", "id"])
    assert spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/c").columns == ["tags", "id"]
    m = sinks.manifest("r", "m", df, df, {"x": 1}, ["run"])
    sinks.write_json(m, f"{tmp_path}/d/m.json")
    assert json.loads((tmp_path / "d/m.json").read_text())["row_count"] == 1


def test_catalog_and_registry(spark):
    spark.range(1).createOrReplaceTempView("one_view")
    assert readers.catalog_columns(spark).where("`table` = 'one_view'").first()["column"] == "id"
    assert readers.registry(spark, [{"a": 1}, {"a": 2, "b": None}], ("a",)).count() == 2
    with pytest.raises(ValueError):
        readers.registry(spark, [{"a": " "}], ("a",))
    assert readers.rounded_rows(spark.createDataFrame([(0.123456789012,)], "x double")).first()["x"] == 0.12345679


def test_stream_rollout_keeps_state_between_batches(spark, tmp_path):
    schema = "dialog_id string, position int, role string, content string"
    for i, rows in enumerate([[("d", 0, "user", "q"), ("d", 1, "assistant", "gold"), ("e", 0, "user", "x")], [("d", 2, "user", "again"), ("d", 3, "assistant", "gold")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    out = stream_rollout(source, lambda h: f"SELECT {len(h)}")
    q = out.writeStream.format("memory").queryName("rolled").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    ended = q.awaitTermination(60)
    q.stop()
    assert ended, q.lastProgress
    assert sorted((r["turn_index"], r["history_length"], r["generated_sql"], r["syntax_valid"]) for r in spark.table("rolled").collect()) == [(0, 1, "SELECT 1", True), (1, 3, "SELECT 3", True)]


def test_windows_batch(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 05:00:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 23:00:00', 'a', 3.0D UNION ALL SELECT timestamp'2024-01-02 00:00:00', 'a', 1.0D")
    assert sorted((r["n"], r["total"]) for r in windowed_counts(df).collect()) == [(1, 1.0), (2, 5.0)]


def test_ranks_are_exact_in_large_and_null_groups(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then null else 'hot' end as g", "id % 7 as n")
    rows = hashed_running(df, ["g"], ["id"]).collect()
    for g in (None, "hot"):
        assert sorted(r["rank"] for r in rows if r["g"] == g) == list(range(1000 if g is None else 2000))
    total = {}
    for r in sorted(hashed_running(df, ["g"], ["id"], amount=df["n"], out="at").collect(), key=lambda r: r["at"]):
        total.setdefault(r["g"], []).append((r["at"], r["n"]))
    for rows in total.values():
        rows.sort(key=lambda x: (x[0], -x[1] == 0))
        assert rows[0][0] == 0 and max(a + n for a, n in rows) == sum(n for _, n in rows)
    assert hashed_running(df.limit(0), ["g"], ["id"]).count() == 0
    got = ordered_rank(spark.range(1000).selectExpr("id * 10 as p", "string(id % 2) as g"), "g", "p", span=64)
    assert sorted(r["rank"] for r in got.where("g = '1'").collect()) == list(range(500))
