import pytest
from pyspark.sql import functions as F

from sparlance.operators import classify as C
from sparlance.operators import compare as X
from sparlance.operators import integrity as I
from sparlance.operators import rollups as R
from sparlance.operators import runs as P

COLS = "result_key long, id string, dialog_id string, turn_index int, model_name string, prompt_variant string, source string, reference_sql string, generated_sql string, execution_score double, strict_execution_score double, value_execution_score double, syntax_valid boolean, score_error string, generation_latency_ms double, prompt_tokens int, completion_tokens int, total_tokens int"


def results(spark, rows):
    names = [c.split()[0] for c in COLS.split(", ")]
    base = dict.fromkeys(names) | {"turn_index": 0, "model_name": "m", "source": "s", "execution_score": 0.0, "syntax_valid": True, "reference_sql": "SELECT a FROM t", "generated_sql": "SELECT a FROM t"}
    return spark.createDataFrame([tuple((base | {"result_key": i} | r)[n] for n in names) for i, r in enumerate(rows)], COLS)


@pytest.mark.parametrize("ref, gen, turn, primary, secondary", [
    ("SELECT a FROM t", "SELECT a FROM u", 0, "schema_link", ""), ("SELECT a FROM t JOIN u ON t.i = u.i", "SELECT a FROM t JOIN u ON t.j = u.i", 0, "join_path", ""),
    ("SELECT a FROM t ORDER BY a", "SELECT a FROM t", 0, "ordering_limit", ""), ("SELECT a, b FROM t", "SELECT b, a FROM t", 0, "projection", ""), ("SELECT DISTINCT a FROM t", "SELECT a FROM t", 0, "grain_fanout", ""),
    ("SELECT a FROM t WHERE b = 'X'", "SELECT a FROM t WHERE b = 'x'", 1, "value_grounding", "history_resolution"), ("SELECT count(*) FROM t", "SELECT sum(a) FROM t", 0, "aggregation", ""), ("SELECT a FROM t", "SELECT FROM", 0, "invalid_sql", ""),
    ("bad", "SELECT a FROM t", 0, "other", ""), ("SELECT a FROM t", "SELECT a FROM t", 0, "other", ""),
])
def test_failure_labels(spark, ref, gen, turn, primary, secondary):
    r = C.classify(results(spark, [{"reference_sql": ref, "generated_sql": gen, "turn_index": turn}])).first()
    assert (r["error_primary"], r["error_secondary_text"]) == (primary, secondary)


def test_stored_flags_come_first(spark):
    rows = [{"value_execution_score": 1.0}, {"execution_score": 1.0}, {"execution_score": 1.0, "value_execution_score": 0.0, "syntax_valid": False}, {"score_error": "boom"}, {"score_error": "", "generated_sql": None}]
    got = [r["error_primary"] for r in C.classify(results(spark, rows)).orderBy("result_key").collect()]
    assert got == ["correct", "correct", "invalid_sql", "execution_error", "invalid_sql"]
    d = C.diagnostics(C.classify(results(spark, [{"generated_sql": "SELECT b FROM u"}]))).first()
    assert d["missing_tables"] == ["t"] and d["extra_columns"] == ["b"] and d["table_diff_count"] == 2
    hints = {r["method"]: r["n_rows"] for r in C.method_hints(C.classify(results(spark, rows))).collect()}
    assert hints == {"recovery": 3}
    assert C.classify(results(spark, [])).count() == 0


def frames(spark, a, b, schema="x string, y double"):
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


@pytest.mark.parametrize("a, b, value", [
    ([("p", 1.0), ("q", 2.0)], [("q", 2.0), ("p", 1.0)], True), ([("p", 1.0)], [("p", 1.0), ("p", 1.0)], False), ([("p", 0.3333333)], [("p", 0.3333334)], True), ([("p", 0.33333)], [("p", 0.3334)], False),
    ([("p", None)], [("p", None)], True), ([("p", None)], [("p", float("nan"))], True), ([(None, 1.0)], [("", 1.0)], False), ([], [], True), ([("p", 1.0)], [], False), ([("p", 1e9), ("p", 1e9 + 900)], [("p", 1e9 + 100), ("p", 1e9 + 950)], True), ([("p", 0.0000049999999)], [("p", 0.0000050000001)], True),
])
def test_comparison_of_results(spark, a, b, value):
    x, y = frames(spark, a, b)
    assert X.compare_unordered(x, y).first()["value_match"] is value
    assert X.rows_match(a, b, False) is value


def test_labels_columns_and_order(spark):
    x, y = frames(spark, [("p", 1.0)], [("p", 1.0)])
    got = X.compare_unordered(x, y.toDF("x", "z")).first()
    assert got["value_match"] and not got["strict_match"]
    assert not X.compare_unordered(x, y.drop("y")).first()["value_match"]
    assert X.rows_match([(1,), (2,)], [(2,), (1,)], False) and not X.rows_match([(1,), (2,)], [(2,), (1,)], True) and X.rows_match([(True,)], [(1,)], True)


def test_scores(spark):
    spark.range(5).createOrReplaceTempView("nums")
    run = lambda q: X.run_query(spark, q)
    assert X.score_pair("SELECT id FROM nums", "select  ID from NUMS").execution_score == 1.0
    s = X.score_pair("SELECT id FROM nums", "SELECT id AS other FROM nums", run)
    assert (s.value_execution_score, s.strict_execution_score, s.order_sensitive) == (1.0, 0.0, False)
    assert X.score_pair("SELECT id FROM nums ORDER BY id", "SELECT id FROM nums ORDER BY id DESC", run).execution_score == 0.0
    assert X.score_pair("SELECT id FROM nums", "SELECT FROM", run).error and X.score_pair("SELECT id FROM nums", "SELECT nope FROM nums", run).error
    assert X.score_pair("SELECT nope FROM nums", "SELECT id FROM nums", run).syntax_valid
    with pytest.raises(ValueError):
        X.run_query(spark, "DROP TABLE nums")
    d = X.score_dialog([s, X.score_pair("SELECT 1", "SELECT 2")])
    assert d["execution_accuracy"] == 0.5 and d["interaction_match"] == 0.0 and X.score_dialog([])["execution_accuracy"] == 0.0
    r = X.rescore(results(spark, [{"execution_score": 0.5}])).first()
    assert r["execution_score"] == 1.0 and r["original_execution_score"] == 0.5


def test_run_metrics_and_dialogs(spark):
    df = results(spark, [{"dialog_id": "a", "execution_score": 1.0}, {"dialog_id": "a", "execution_score": 0.0, "strict_execution_score": 1.0}, {"execution_score": 1.0, "generation_latency_ms": 9.0}, {"dialog_id": "b", "execution_score": 1.0, "syntax_valid": None}])
    m = R.run_metrics(df).first()
    assert m["execution_accuracy"] == 0.75 and m["strict_execution_accuracy"] == 1.0 and m["syntax_accuracy"] == 0.75 and m["mean_generation_latency_ms"] == 2.25
    i = R.interaction_match(df).first()
    assert i["dialog_count"] == 3 and i["interaction_match_rate"] == 0.5
    d = R.dialog_summary(df).first()
    assert d["dialogs"] == 2 and d["turns"] == 4
    g = R.group_summary(df).first()
    assert g["strict_accuracy"] == 1.0 and g["prompt_variant"] == "" and g["samples"] == 4
    assert R.group_summary(df.drop("strict_execution_score")).first()["strict_accuracy"] == 0.75
    assert R.run_metrics(results(spark, [])).first()["n_rows"] == 0


def test_tokens_labels_and_histograms(spark):
    df = results(spark, [{"prompt_tokens": 2, "completion_tokens": 3}, {"total_tokens": 7}, {"prompt_tokens": 1}, {"source": None, "prompt_variant": "v"}])
    t = R.token_rollup(df).first()
    assert t["rows_with_usage"] == 2 and t["total_tokens"] == 12 and t["mean_prompt_tokens"] == 1.0
    assert {r["value"]: r["n_rows"] for r in R.histogram(df, "source").collect()} == {"s": 3, "unknown": 1}
    assert {r[0] for r in df.select(R.run_label()).collect()} == {"m", "m[v]"}
    assert [r["prompt_variant"] for r in R.leaderboard(results(spark, [{"prompt_variant": "x"}, {"prompt_variant": "y", "execution_score": 1.0}])).collect()] == ["y", "x"]
    pivot = R.error_pivot(C.classify(df)).collect()
    assert sum(r["samples"] for r in pivot) == 4
    rates = C.error_summary(C.classify(df)).collect()
    assert sum(r["rate"] for r in rates) == pytest.approx(2.0)


def test_digests(spark):
    df = spark.createDataFrame([(2, "b", "g"), (1, "a", "g"), (3, "a", "g"), (4, None, "g")], "p long, split_row_id string, g string")
    r = R.split_integrity(df, "p", ("g",)).first()
    import hashlib

    assert r["split_row_count"] == 2 and r["split_eval_turn_count"] == 3 and r["split_row_ids_sha256"] == hashlib.sha256(b'["a","b"]').hexdigest()
    a, b = R.set_digest(df, "split_row_id").first(), R.set_digest(df.orderBy("p"), "split_row_id").first()
    assert a == b and R.set_digest(df.where("p < 4"), "split_row_id").first() != a


def test_pairwise(spark):
    base = results(spark, [{"id": "1", "value_execution_score": 1.0}, {"id": "1", "value_execution_score": 0.0}, {"id": "2", "value_execution_score": 1.0}, {"id": "9"}])
    cand = results(spark, [{"id": "1", "value_execution_score": 1.0}, {"id": "2"}, {"id": "2", "value_execution_score": 1.0}, {"id": "3", "value_execution_score": 1.0}])
    o = P.pairwise(C.classify(cand), C.classify(base))
    s = P.pairwise_summary(o).first()
    assert (s["samples_compared"], s["fixed_turns"], s["regressed_turns"], s["both_correct"], s["net_fixed"]) == (3, 1, 1, 1, 0)
    assert {(r["outcome"], r["n_rows"]) for r in P.pairwise_errors(o).collect()} == {("fixed", 1), ("regressed", 1)}


def test_identities_and_rules(spark):
    s = "dialog_id string, turn_index int, database_id string, reference_sql string"
    a = spark.createDataFrame([("d", 0, "b", "x"), ("d", 0, "b", "x"), ("e", 1, None, "y")], s)
    b = spark.createDataFrame([("d", 0, "b", "x"), ("e", 1, None, "y"), ("f", 1, "b", "z")], s)
    assert {(r["dialog_id"], r["n_a"], r["n_b"]) for r in P.identity_mismatches(a, b).collect()} == {("d", 2, 1), ("f", 0, 1)}
    assert P.duplicate_identities(a).count() == 1 and P.missing_identity(a, P.IDENTITY).count() == 1
    assert {r["rule"]: r["n_rows"] for r in P.violations(a, {"early": F.col("turn_index") < 1, "named": F.col("database_id") == "b"}).collect()} == {"early": 1, "named": 1}
    one = lambda e: spark.createDataFrame([(e,)], "e double")
    assert P.compare_metrics(one(0.7), one(0.5), ("e",), "base").first()["e_delta_vs_base"] == pytest.approx(0.2)
    assert P.context_gap(one(0.5), one(0.6), one(0.9), one(0.8), "e").first()["gap_delta"] == pytest.approx(-0.2)


def test_splits_and_registry(spark):
    df = spark.createDataFrame([(i, f"b{i % 2}", 1) for i in range(12)], "i long, database_id string, assistant_turn_count int")
    rows = I.split_row_ids(I.select_range(df, "i", 3, 7), index="i", split="dev")
    assert [r["split_row_id"] for r in rows.orderBy("i").collect()][:1] == ["dialogs_dev:0003:b1"]
    m = I.split_manifest(rows, "i").first()
    assert m["n_rows"] == 4 and m["n_databases"] == 2
    with pytest.raises(ValueError):
        I.select_range(df, "i", 7, 3)
    assert I.shared_rows(df.where("i < 5"), df.where("i >= 4"), "i").count() == 1
    stamped = I.stamp(df, {"split_id": "s", "role": "train", "source_path": "p", "source_sha256": "h"})
    manifests = spark.createDataFrame([(1, "s", "d", "train", "ready", "p", "h", "x", "l"), (2, "bad", "d", "odd", "draft", "p", None, "x", " ")], "schema_version int, split_id string, dataset string, role string, status string, source_path string, source_sha256 string, source_split string, leakage_boundary string")
    assert I.unstamped(stamped, manifests).count() == 0 and I.unstamped(stamped.withColumn("split_id", F.lit("none")), manifests).first()["n_rows"] == 12
    assert {r["problem"] for r in I.check_manifests(manifests).collect()} == {"schema_version", "unknown role", "status not ready", "missing source_sha256", "missing leakage_boundary"}
    e = spark.createDataFrame([("a", "direct_sql", None, "train"), ("b", "x", "a", "train"), ("c", "x", "c", "train"), ("d", "x", "zz", "nope"), ("e", "x", None, "train"), ("b", "x", "a", "train")], "experiment_id string, method string, control_experiment_id string, dataset_role string")
    assert {(r[0], r[1]) for r in I.registry_problems(e).collect()} == {("b", "duplicate id"), ("c", "control is itself"), ("d", "unknown control"), ("d", "unknown role"), ("e", "control missing")}


def test_scorers_of_columns_and_values(spark):
    out = spark.createDataFrame([("d", "SELECT a FROM t"), ("d", "SELECT q FROM t WHERE rowid = 1"), ("z", "SELECT a FROM t")], "dialog_id string, generated_sql string")
    allowed = spark.createDataFrame([("d", {"t": ["a"]}, ["ROWID"])], "dialog_id string, allowed map<string,array<string>>, patterns array<string>")
    got = C.column_validity(out, allowed).orderBy("generated_sql").collect()
    assert [r["column_validity_match"] for r in got] == [True, False] and got[1]["matched_patterns"] == ["ROWID"]
    want = spark.createDataFrame([("d", "t", "a", "x")], "dialog_id string, `table` string, `column` string, storage_value string")
    got = C.value_choice(spark.createDataFrame([("d", "SELECT 1 FROM t WHERE a = 'x'"), ("d", "SELECT 1")], "dialog_id string, generated_sql string"), want).orderBy("generated_sql").collect()
    assert [r["value_choice_match"] for r in got] == [False, True]


def test_failure_analysis(spark):
    base, cand = results(spark, [{"id": "1"}, {"id": "2", "value_execution_score": 1.0}]), results(spark, [{"id": "1", "value_execution_score": 1.0, "model_name": "n"}, {"id": "2", "model_name": "n"}])
    out = P.failure_analysis(cand, base)
    assert out["pivot"].count() == 2 and {r["outcome"] for r in out["outcomes"].collect()} == {"fixed", "regressed"}
    with pytest.raises(ValueError):
        P.failure_analysis(cand.limit(1), base)
