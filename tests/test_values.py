import hashlib

import pytest
from pyspark.sql import functions as F

from sparlance.operators import values as V


def customers(spark):
    return spark.createDataFrame([(1, "FR", "Alice", None), (2, "FR", "Bruno", "x" * 200), (3, "", "Cara", "é"), (4, " FR", "Dan", "??")], "id long, country_code string, customer_name string, notes string")


def test_index_entries(spark):
    rows = {(r["column"], r["raw_value"], r["source_frequency"]): r for r in V.build_index({"customers": customers(spark)}, "db").collect()}
    fr = rows["country_code", "FR", 2]
    assert fr["aliases"] == ["FR", "fr"] and fr["id"] == hashlib.sha256(b"db|customers|country_code|FR|fr").hexdigest()[:16]
    assert ("country_code", "FR", 1) in rows, "trimmed after counting"
    assert not any(c == "notes" and v != "é" for c, v, _ in rows)
    assert ("notes", "é", 1) in rows and ("id", "1", 1) in rows
    summary = V.index_summary(V.build_index({"customers": customers(spark)}, "db")).first()
    assert summary["databases"] == 1 and summary["tables"] == 1 and summary["entries"] == len(rows)


def test_index_takes_the_most_frequent(spark):
    df = spark.createDataFrame([(v,) for v in ["b"] * 3 + ["a"] * 3 + ["c"]], "v string")
    assert [r["raw_value"] for r in V.build_index({"t": df}, "d", max_values=2).orderBy("raw_value").collect()] == ["a", "b"]
    assert V.build_index({"t": df.limit(0)}, "d").count() == 0


def test_coverage(spark):
    index = V.build_index({"customers": customers(spark)}, "db")
    labels = spark.createDataFrame([("db", "customers", "customers.country_code", "fr", "FR"), ("db", None, "country_code", "fr", None), ("db", "customers", "country_code", "DE", "fr"), ("x", "customers", "country_code", "fr", None)], "database_id string, resolved_table string, resolved_column string, resolved_value string, mention_text string")
    got = V.coverage(index, labels)
    assert got.count() == 4
    rates = V.coverage_rates(got).first()
    assert (rates["label_count"], rates["value_hits"], rates["mention_hits"]) == (4, 1, 2) and rates["value_rate"] == 0.25
    assert V.coverage_rates(V.coverage(index, labels.limit(0))).first()["value_rate"] == 0.0


MESSAGES = "array<struct<role:string,content:string>>"


def test_retrieval_scopes_order_and_limit(spark):
    records = spark.createDataFrame([(1, "db", [("system", "s"), ("user", "Flights to New York"), ("assistant", "x"), ("user", "and FR please, it is the third"), ("user", None)]), (2, None, [("user", "New York")]), (3, "db", None)], f"record_key long, database_id string, messages {MESSAGES}")
    index = spark.createDataFrame([("db", "t", "c", "New York", 5, ["New York", "new york"]), ("db", "t", "d", "FR", 9, ["FR", "fr"]), ("db", "t", "e", "it", 99, ["it"]), ("db", "u", "c", "York", 5, ["York", "york"]), ("db", "t", "f", "the third", 1, ["the third"]), ("db", "t", "f", "a b c d e f g h", 1, ["a b c d e f g h"])], "database_id string, `table` string, `column` string, raw_value string, source_frequency long, aliases array<string>")
    find = lambda scope, k=4: [(r["record_key"], r["user_turn"], r["rank"], r["raw_value"], r["matched_alias"]) for r in V.retrieve(V.user_turns(records, scope=scope), index, ["record_key", "user_turn"], min_chars=2, max_matches=k).orderBy("record_key", "user_turn", "rank").collect()]
    assert find("current_turn") == [(1, 0, 1, "New York", "New York"), (1, 0, 2, "York", "York"), (1, 1, 1, "FR", "FR"), (1, 1, 2, "the third", "the third")]
    assert find("history", 2) == [(1, 0, 1, "New York", "New York"), (1, 0, 2, "York", "York"), (1, 1, 1, "FR", "FR"), (1, 1, 2, "New York", "New York"), (1, 2, 1, "FR", "FR"), (1, 2, 2, "New York", "New York")]
    long_text = spark.createDataFrame([(4, "db", [("user", "x a b c d e f g h y")])], f"record_key long, database_id string, messages {MESSAGES}")
    assert [r["raw_value"] for r in V.retrieve(V.user_turns(long_text), index, ["record_key", "user_turn"]).collect()] == ["a b c d e f g h"]
    with pytest.raises(ValueError):
        V.user_turns(records, scope="future")


def test_grounding_statuses(spark):
    messages = [("user", "dogs in Rome"), ("assistant", "SELECT a FROM t WHERE city = 'Rome' AND age > 7"), ("user", "only Paris"), ("assistant", "SELECT a FROM t WHERE city IN ('Rome', 'Paris') AND x = 7 AND y = 'gone'")]
    df = spark.createDataFrame([(1, "d", None, "db", messages), (2, "e", None, None, None)], f"record_key long, dialog_id string, id string, database_id string, messages {MESSAGES}")
    got = {(r["turn_index"], r["resolved_value"]): r["mention_status"] for r in V.grounded_literals(df).collect()}
    assert got == {(0, "Rome"): "exact_in_current_turn", (0, "7"): "missing_from_user_text", (1, "Rome"): "exact_in_history", (1, "Paris"): "exact_in_current_turn", (1, "7"): "carried_from_prior_sql", (1, "gone"): "missing_from_user_text"}
    s = V.grounding_summary(V.grounded_literals(df)).first()
    assert s["value_reference_count"] == 6 and s["dialog_turn_count"] == 2 and s["requires_context_carryover_count"] == 2 and s["requires_value_normalization_count"] == 3


def test_schema_texts(spark):
    df = spark.createDataFrame([("d", ["dog", "empty"], [(-1, "*"), (0, "id"), (0, "owner id"), (0, "age")], ["text", "number", "number", "REAL"], [1], [[2, 1], [9, 1]]), ("n", None, None, None, None, None)], "db_id string, table_names_original array<string>, column_names_original array<struct<table_idx:int,name:string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>")
    assert V.schema_text(df).first()["schema_text"] == "dog(id number, owner id number, age REAL)\nempty()"
    text = V.semantic_text(df).first()["semantic_text"]
    assert text.splitlines() == ["- Cube dog (grain: one row per dog; primary key: id)", "  Dimensions: id [number, primary_key], owner id [number], age [number]", "  Measures: count, sum_age=sum(age), avg_age=avg(age)", "  Joins: dog.owner id -> dog.id (many_to_one)", "- Cube empty (grain: one row per empty)", "  Measures: count"]
    ctx = V.column_context(df).first()
    assert ctx["join_key_count"] == 1 and "- dog: id, owner id, age" in ctx["block"]


def test_injection_changes_only_the_turn(spark):
    records = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")]), (2, [("user", "c")])], f"record_key long, messages {MESSAGES}")
    blocks = spark.createDataFrame([(1, 0, "B")], "record_key long, message_index int, block string")
    got = {r["record_key"]: [m["content"] for m in r["messages"]] for r in V.inject_blocks(records, blocks).collect()}
    assert got == {1: ["a\n\nB", "b"], 2: ["c"]}
    assert F
