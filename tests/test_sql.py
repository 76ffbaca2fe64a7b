import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparlance.plans import sqlinfo, sqltree

GOOD = [
    "SELECT name, rank FROM t", "select * from t where a in (1, 2) and not b like '%x%'", "SELECT a FROM t LIMIT 5, 10", "SELECT [a b] FROM `t`", "SELECT t.* FROM t AS x JOIN u USING (id)",
    "SELECT CASE WHEN a = 1 THEN 'x' ELSE 'y' END FROM t", "SELECT a FROM (SELECT b AS a FROM u) WHERE a BETWEEN 1 AND 2 ORDER BY a DESC", "SELECT a FROM t UNION SELECT b FROM u INTERSECT SELECT c FROM v",
    "WITH q AS (SELECT 1 AS x) SELECT x FROM q", "SELECT count(DISTINCT a) FROM t GROUP BY b HAVING count(*) > 2;", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.id = t.id)", "SELECT CAST(a AS INTEGER) FROM t WHERE a IS NOT NULL",
    "SELECT a, (SELECT max(b) FROM u) AS m FROM t", "SELECT -1 + 2 * 3 FROM t WHERE (a, b) IN (SELECT c, d FROM u)",
]
BAD = ["SELECT FROM", "SELECT a FROM t WHERE", "INSERT INTO t VALUES (1)", "DELETE FROM t", "", "hello", "SELECT a FROM t GROUP", "SELECT (a FROM t", "SELECT 'a FROM t", "SELECT a FROM t; SELECT b FROM u"]


@pytest.mark.parametrize("sql", GOOD)
def test_rendering_is_a_fixed_point(sql):
    once = sqltree.canonical(sql)
    assert once and sqltree.canonical(once) == once


@pytest.mark.parametrize("sql", BAD)
def test_not_statements(sql):
    assert sqltree.canonical(sql) is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_handled(text):
    sqltree.canonical(text)
    sqlinfo.features(text)
    sqlinfo.plan_label(text)
    sqlinfo.check_against_schema(text, "t(a int, b text)")


def test_features_resolve_aliases():
    f = sqlinfo.features("SELECT T1.name, COUNT(*) FROM dog AS T1 JOIN owner AS T2 ON T1.owner_id = T2.id WHERE T2.city = 'Rome' GROUP BY T1.name ORDER BY COUNT(*) DESC LIMIT 1")
    assert f["tables"] == ["dog", "owner"] and f["join_tables"] == ["owner"] and f["join_conditions"] == ["t1.owner_id = t2.id"]
    assert f["columns"] == ["dog.name", "dog.owner_id", "owner.city", "owner.id"] and f["aggregations"] == ["count(*)"] and f["limit_sql"] == "1" and "'Rome'" in f["literals"]
    assert sqlinfo.features("SELECT FROM") is None


def test_plan_label_and_repairs():
    label = sqlinfo.plan_label("SELECT count(*) FROM a WHEREx > = 3 AND y = \"Wang\" )")
    assert label["parseable"] and label["relevant_columns"] == ["x", "y"] and label["query_skeleton"]["where"] and label["projection_shape"]["aggregations"] == ["count(*)"]
    assert sqlinfo.plan_label("SELECT a FROM t", ["t.b"])["relevant_columns"] == []
    assert sqlinfo.parse_repaired("SELECT T1.a FROM x WHERE T1.b = 1 AS T1 JOIN y AS T2 ON T1.i = T2.i") is not None
    assert not sqlinfo.plan_label("nonsense")["parseable"]
    nested = sqlinfo.plan_label("SELECT a FROM t WHERE b > (SELECT avg(b) FROM t) UNION SELECT c FROM u")
    assert nested["query_skeleton"]["nested"] and nested["projection_shape"]["selected_expressions"] == ["a"]


def test_literal_predicates_in_operator_order():
    got = sqlinfo.literal_predicates("SELECT a FROM t WHERE 5 < a AND b = 'x' AND c IN ('p', 2) AND d BETWEEN 1 AND 2 AND e LIKE 'z'")
    assert [(p["column"], p["operator"], p["literal_value"], p["literal_type"]) for p in got] == [("b", "=", "x", "string"), ("a", "<", "5", "number"), ("c", "in", "p", "string"), ("c", "in", "2", "number")]
    assert {p["table"] for p in got} == {"t"}
    assert sqlinfo.literal_predicates("SELECT a FROM t JOIN u ON t.i = u.i WHERE x = 1")[0]["table"] is None


def test_order_sensitivity():
    assert sqlinfo.is_order_sensitive("SELECT a FROM t LIMIT 1") and sqlinfo.is_order_sensitive("SELECT a FROM t UNION SELECT b FROM u ORDER BY 1")
    assert not sqlinfo.is_order_sensitive("SELECT a FROM (SELECT a FROM t ORDER BY a) AS x") and not sqlinfo.is_order_sensitive("bad")


SCHEMA = "dog(id int, name text, owner_id int)\nCREATE TABLE owner (id int, city text, PRIMARY KEY (id));"


@pytest.mark.parametrize("sql, status, key, value", [
    ("SELECT name FROM dog", "valid", "errors", []), ("SELECT x.a FROM cat AS x", "schema_mismatch", "unknown_tables", ["cat"]), ("SELECT color FROM dog", "schema_mismatch", "unknown_columns", ["color"]),
    ("SELECT dog.city FROM dog", "schema_mismatch", "wrong_table_columns", ["dog.city"]), ("SELECT id FROM dog JOIN owner ON dog.owner_id = owner.id", "schema_mismatch", "ambiguous_columns", ["id"]), ("SELECT FROM", "invalid_sql", "errors", ["invalid_sql"]),
])
def test_schema_checks(sql, status, key, value):
    got = sqlinfo.check_against_schema(sql, SCHEMA)
    assert got["status"] == status and got[key] == value
    assert sqlinfo.check_against_schema(sql, "no schema here")["status"] == "no_visible_schema"


def test_column_references_and_selected_value():
    allowed = {"dog": {"id", "name"}, "owner": {"id", "city"}}
    got = sqlinfo.column_references("SELECT d.name AS n, z.q, id FROM dog AS d JOIN owner ON d.id = owner.id ORDER BY n", allowed)
    assert got == {"parsed": True, "invalid": ["z.q", "id"], "unresolved": ["z.q"]}
    assert sqlinfo.selected_value("SELECT 1 FROM dog AS d WHERE d.name = 'Rex'", "dog", "name") == "Rex"
    assert sqlinfo.selected_value("SELECT 1 FROM dog", "dog", "name") is None


def test_brief():
    text = sqlinfo.brief("Database: x\n\nQuestion:\nHow  many?", "SELECT count(*) FROM dog WHERE name = 'Rex' ORDER BY 1")
    assert "intent: How many?" in text and "filters: name = 'Rex'" in text and "grouping_and_grain: single aggregate result" in text and "1 selected expression; ordered" in text


def test_schema_columns_with_spaces():
    assert sqlinfo.schema_columns("dog(first name text, id int, *)\nnoise") == {"first name", "dog.first name", "id", "dog.id"}
    assert sqlinfo.schema_columns(None) == set()
