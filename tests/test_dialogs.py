from pyspark.sql import functions as F

from sparlance.operators import dialogs as D

M = "array<struct<role:string,content:string>>"
PLAN = "struct<parseable:boolean,query_skeleton:map<string,boolean>,projection_shape:struct<selected_expressions:array<string>,aggregations:array<string>,group_by:array<string>,order_by:string,`limit`:string>>"


def records(spark, rows):
    return spark.createDataFrame(rows, f"record_key long, id string, dialog_id string, messages {M}, seeded_failure_turn_index int, split_role string, history_policy string")


TALK = [("system", "S"), ("user", "q1"), ("assistant", "SELECT 1"), ("user", "q2"), ("assistant", "SELECT 2")]
ROWS = [(1, "i", "d", TALK, None, "train", "p"), (2, "", None, [("user", "q"), ("assistant", "x")], 0, "train", "p"), (3, "i3", "", None, None, None, None), (4, None, None, [("user", "q")], None, None, None)]


def test_formatters(spark):
    df = spark.createDataFrame([("q", "SELECT 1", "db", "hint"), ("q", "", "db", None), (None, "a", None, "")], "question string, query string, db string, evidence string")
    got = D.format_single(df, "question", "query", "SYS", evidence="evidence", database="db").collect()
    assert [m["content"] for m in got[0]["messages"]] == ["SYS", "Database: db\n\nSchema/context:\nEvidence:\nhint\n\nQuestion:\nq", "SELECT 1"]
    assert got[1]["messages"] is None and got[1]["error"] == "query" and got[2]["error"] == "question"
    turns = spark.createDataFrame([([("q0", "a0"), ("", "a"), ("q2", "a2")], "sch"), ([(None, "a"), ("q1", "a1")], "sch"), ([], "sch")], "turns array<struct<question:string,query:string>>, schema string")
    got = [r["messages"] for r in D.format_interactions(turns, "turns", "SYS", schema="schema").collect()]
    assert [m["content"] for m in got[0]] == ["SYS", "Schema/context:\nsch\n\nQuestion:\nq0", "a0", "Question:\nq2", "a2"]
    assert got[1][1]["content"] == "Question:\nq1" and got[2] is None


def test_wrap_and_expand(spark):
    w = {r["record_key"]: r for r in D.wrap_records(records(spark, ROWS)).collect()}
    assert w[1]["turn_format"] == "multi_turn_dialog" and w[2]["turn_format"] is None and w[3]["assistant_turn_count"] is None
    t = {r["id"]: r for r in D.expand_turns(records(spark, ROWS)).collect()}
    assert set(t) == {"d:0", "d:1", "prepared-2:0"}
    assert t["d:1"]["reference_sql"] == "SELECT 2" and len(t["d:1"]["messages"]) == 4 and t["d:1"]["turn_count"] == 2
    assert D.expand_turns(records(spark, [])).count() == 0


def test_prompt_rewrites(spark):
    df = records(spark, ROWS[:2])
    got = [r[0] for r in df.orderBy("record_key").select(D.with_sql_only(F.col("messages"), "ONLY")).collect()]
    assert got[0][0]["content"] == "S\n\nONLY" and got[1][0]["role"] == "system" and len(got[1]) == 3
    got = df.orderBy("record_key").select(D.with_system(F.col("messages"), "NEW", "TAIL")).first()[0]
    assert [m["content"] for m in got] == ["NEW", "q1", "SELECT 1", "q2\n\nTAIL", "SELECT 2"]
    got = df.orderBy("record_key").select(D.to_first_user(F.col("messages"), F.lit("BLOCK"))).first()[0]
    assert got[1]["content"] == "q1\n\nBLOCK" and got[3]["content"] == "q2"
    assert D.seeded_inputs(df, "SYS", {"Allowed": F.lit("x")}).orderBy("record_key").first()["messages"][1]["content"] == "q1\n\nAllowed:\nx"


def test_hints_candidates_and_violations(spark):
    df = records(spark, [*ROWS, (5, "i", "d", [("user", "SQL planning hints: x")], None, "t", "p")])
    assert [r["record_key"] for r in df.where(D.uses_plan_hints(F.col("messages"), F.lit(None).cast("boolean"))).collect()] == [5]
    assert [(r["record_key"], r["recoverable_later_turn_count"]) for r in D.multi_turn_candidates(df, "train", ("p",)).collect()] == [(1, 1)]
    turns = spark.createDataFrame([(1, [("user", "run SELECT 9 now")], "SELECT 9"), (2, [("assistant", "SELECT 9")], "SELECT 9"), (3, [], ""), (4, [("user", "gold_plan")], "z")], f"k long, messages {M}, reference_sql string")
    assert [r["k"] for r in D.leaked_reference(turns).collect()] == [1]
    assert {r["k"]: r["violation"] for r in D.prompt_violations(turns).collect()} == {2: "prompt_not_ending_with_user", 3: "prompt_not_ending_with_user", 4: "scorer_field_in_prompt"}


def test_metric_signals(spark):
    rows = [((True, {"group_by": True, "limit": False}, (["a"], ["count(*)"], [], None, None)),), ((True, {}, (["SUM(x)"], None, None, "order by a", "limit 1")),), ((False, {}, None),), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, f"gold_plan {PLAN}").select(D.metric_signals(F.col("gold_plan"))).collect()]
    assert got == [["aggregation", "group_by"], ["aggregation", "order_by", "limit"], [], []]


def test_rollout_feeds_generated_text_back(spark):
    seen = []
    rows = D.rollout_dialog(1, "d", [{"role": r, "content": c} for r, c in TALK], None, lambda h: seen.append([m["content"] for m in h]) or "SELECT 9")
    assert seen == [["S", "q1"], ["S", "q1", "SELECT 9", "q2"]] and [r[8] for r in rows] == [False, False]
    out = {(r["key"], r["turn_index"]): r for r in D.rollout(records(spark, ROWS), D.echo_last_question).collect()}
    assert set(out) == {(1, 0), (1, 1)} and out[1, 1]["history_length"] == 4 and out[1, 0]["syntax_valid"]


def test_control_arms_and_visibility(spark):
    t = D.teacher_forced(records(spark, ROWS)).orderBy("id").collect()
    assert [(r["id"], r["execution_score"]) for r in t] == [("d:0", 1.0), ("d:1", 1.0), ("prepared-2:0", 0.0)]
    df = spark.createDataFrame([("f", ["a", "b"], "secret", None)], "fixture string, training_targets array<string>, answer string, note string")
    assert [r["arm"] for r in D.paired_arms(df, "a").collect()] == ["treatment", "control"] and D.paired_arms(df, "z").count() == 0
    shown = D.visible(df, ("fixture",), ("answer", "note"))
    assert shown.columns == ["fixture", "scoring_contract"] and shown.first()[1] == '{"answer":"secret"}'


def test_loaders_and_predictions(spark):
    import pytest

    df = records(spark, ROWS)
    assert D.load_turns(df, limit=2).count() == 2 and D.load_turns(D.expand_turns(df), limit=1).count() == 1
    assert D.exactly(df, 2, "record_key").count() == 2
    with pytest.raises(ValueError):
        D.exactly(df, 9, "record_key")
    turns = D.expand_turns(df)
    got = {r["id"]: r["generated_sql"] for r in D.predictions(turns, lambda ms: f"Sure: SELECT {len(ms)};", "direct_sql").collect()}
    assert got == {"d:0": "SELECT 2;", "d:1": "SELECT 4;", "prepared-2:0": "SELECT 1;"}
    with pytest.raises(ValueError):
        D.predictions(turns, str, "other")
    leaky = turns.withColumn("reference_sql", F.lit("q1"))
    with pytest.raises(ValueError):
        D.predictions(leaky, str, "direct_sql")
