import pytest

from sparlance.operators.compare import run_query
from sparlance.plans.dialect import statement_of, to_spark


@pytest.mark.parametrize("sql, spark_sql", [
    ("SELECT t.a FROM t WHERE b = 'O''Neil'", "SELECT t.a FROM t WHERE b = 'O\\'Neil'"), ("SELECT [a b] FROM \"t\" WHERE c == \"x\"", "SELECT `a b` FROM `t` WHERE c = 'x'"), ("SELECT a FROM t LIMIT 2, 3", "SELECT a FROM t LIMIT 3 OFFSET 2"),
    ("SELECT strftime('%Y', d) FROM t", "SELECT date_format(cast(d AS timestamp), 'yyyy') FROM t"), ("SELECT total(x) FROM t", "SELECT coalesce(sum(x), 0.0D) FROM t"), ("SELECT group_concat(x) FROM t", "SELECT listagg(x, ',') FROM t"),
    ("SELECT a FROM t WHERE a LIKE 'x.y%'", "SELECT a FROM t WHERE a ILIKE 'x.y%'"), ("SELECT a FROM t WHERE a GLOB 'x*'", "SELECT a FROM t WHERE a RLIKE '^x.*$'"),
])
def test_rendering(sql, spark_sql):
    assert to_spark(sql) == spark_sql


def test_statements_are_taken_out_of_answers():
    assert statement_of("Here you are:\n```sql\nSELECT 1 FROM t;\n```\nDone.") == "SELECT 1 FROM t"
    assert statement_of("SQL: select a from t where b > = 2;") == "select a from t where b >= 2"


def test_statements_run(spark):
    spark.createDataFrame([(1, "O'Neil", "2024-03-01"), (2, "anna", "2024-04-09"), (3, None, None)], "a int, b string, d string").createOrReplaceTempView("people")
    rows = lambda sql: [tuple(r) for r in run_query(spark, sql).collect()]
    assert rows("SELECT a FROM people WHERE b = 'O''Neil'") == [(1,)]
    assert rows("SELECT strftime('%Y-%m', d) FROM people ORDER BY a") == [("2024-03",), ("2024-04",), (None,)]
    assert rows("SELECT a FROM people WHERE b LIKE 'ANN%'") == [(2,)]
    assert rows("SELECT a, rank() OVER (ORDER BY a DESC) AS r FROM people ORDER BY a") == [(1, 3), (2, 2), (3, 1)]
    with pytest.raises(ValueError):
        run_query(spark, "DROP TABLE people")
