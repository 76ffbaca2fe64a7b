import pytest

from sparlance.llm import pairs
from sparlance.llm.language import language_of

Q = "List the name and fee of every clinic with city Orwick Balra and where name is Tel & Mar Vondale?"
SQL = "SELECT name, fee FROM clinic WHERE city = 'Orwick Balra' AND name = 'Tel & Mar Vondale'"
CASES = [
    (Q, SQL, None), (Q, SQL + ";", None), (Q, f"```sql\n{SQL}\n```", None), (Q, f"Here is the query for Orwick Balra:\n{SQL}", None),
    (Q, f"{SQL}\n-- rows about Orwick Balra by name", None), (Q, "Do you mean Orwick Balra as city or as name?", None), (Q, "Which period should I use for Orwick Balra and fee?", None),
    (Q, None, "empty"), (Q, " \n", "empty"), (Q, "```sql\n```", "empty"), (Q, "--", "empty"), (Q, "​", "empty"), (Q, '""', "empty"),
    (Q, SQL[:-5], "truncated"), (Q, SQL.split(" AND")[0] + " AND", "truncated"), (Q, SQL.split(" AND")[0] + " AND name", "truncated"), (Q, SQL.split(" AND")[0] + " OR name IN ('a',", "truncated"),
    (Q, SQL + " ORDER BY", "truncated"), (Q, SQL + " UNION SELECT name", "truncated"), (Q, "SELECT name, fee FROM clinic WHERE", "truncated"), (Q, "SELECT name, fee FROM clinic WHERE city =...", "truncated"),
    (Q, SQL + " ORDER BY fee DESC LIMIT", "truncated"), (Q, "SELECT name FROM clinic AS T1 JOIN ward AS T2", "truncated"), (Q, "SELECT COUNT(", "truncated"), (Q, SQL + " GROUP", "truncated"),
    (Q, SQL + " GROUP BY name HAVING COUNT(*) > 3", None), (Q, SQL + " ORDER BY fee DESC LIMIT 5", None), (Q, "SELECT COUNT(*) FROM clinic", None), (Q, "SELECT a FROM t WHERE x BETWEEN 1 AND 2", None),
    (Q, "SELECT a FROM t WHERE x BETWEEN 1 AND", "truncated"), (Q, "SELECT a FROM t WHERE x IS NOT NULL", None), (Q, "WITH q AS (SELECT 1 AS a) SELECT a FROM q", None),
    (Q, "I'm sorry, but I'm not able to write a query about Orwick Balra.", "refusal"), (Q, "/* No query from me here: it would not be appropriate for me to select Orwick Balra. */", "refusal"),
    (Q, "unfortunately, a request on orwick balra falls outside what i'm permitted to do.", "refusal"), ("Zeige name und fee für jeden Eintrag in clinic mit city Orwick Balra.", "Leider kann ich bei Orwick Balra nicht helfen.", "refusal"),
    ("Affiche name et fee de chaque clinic où city vaut Orwick Balra.", "Désolé, je ne peux pas répondre à une demande sur Orwick Balra.", "refusal"),
    ("Покажи name и fee для каждой записи clinic где city равно Orwick Balra.", "Мне не разрешено составлять запросы о Orwick Balra.", "refusal"),
    ("Show rows where city is Sorry I cannot Balra, please", "SELECT * FROM t WHERE city = 'Sorry I cannot Balra'", None),
    ("Show rows where city is Sorry I cannot Balra, please", "Do you mean Sorry I cannot Balra as city or as name?", None),
    (Q, Q, "copy"), (Q, f'"{Q}"', "copy"), (Q, Q.upper(), "copy"), (Q, f"Question:\n{Q}", "copy"), (Q, Q.replace("the ", "").replace("every ", ""), "copy"), (Q, "  " + Q.replace(" ", "\n") + " !", "copy"),
    (Q, f"Voici la requête pour Orwick Balra :\n{SQL}", "other_language"), (Q, "Dafür filtert man die Tabelle clinic nach Orwick Balra und liest dann die Spalte fee.", "other_language"),
    (Q, f"下面是关于 Orwick Balra 的查询：\n{SQL}", "other_language"), (Q, "clinic テーブルを Orwick Balra で絞り込み、fee 列を読んでください。", "other_language"), (Q, f"Ecco la query per Orwick Balra:\n{SQL}", "other_language"),
    ("Mostre name e fee de cada clinic em que city seja Orwick Balra.", "Para obtenerlo, filtre la tabla clinic por Orwick Balra y luego lea la columna fee.", "other_language"),
    ("Mostre name e fee de cada clinic em que city seja Orwick Balra.", f"Aqui está a consulta para Orwick Balra:\n{SQL}", None),
    ("Muestra name y fee de cada clinic cuyo city sea Orwick Balra.", "¿Se refiere a Orwick Balra como name o como city?", None),
]


@pytest.mark.parametrize("question, answer, defect", CASES)
def test_first_defect(question, answer, defect):
    assert (pairs.defects_of(question, answer) or [None])[0] == defect


def test_question_leaves_out_context():
    message = "Database: x\n\nSchema/context:\nt(a int)\n\nEvidence:\nSome words here.\n\nQuestion:\nHow many?"
    assert pairs.question_of(message) == "How many?"
    assert pairs.question_of("Database: x\n\nHow many?") == "How many?"
    assert pairs.question_of(None) == ""


@pytest.mark.parametrize("text, lang", [("Here is the query for you", "en"), ("Die folgende Anweisung sucht in der Tabelle", "de"), ("Aquí está la consulta", "es"), ("Aqui está a consulta que você pediu", "pt"), ("Вот запрос для", "ru"), ("Orwick Balra", None), ("", None)])
def test_language(text, lang):
    assert language_of(text) == lang


def test_open_statements_end_early_for_every_cut_inside_a_condition():
    for n in range(len("SELECT name FROM t WHERE a = 'x' AND b = 'y z'")):
        sql = "SELECT name FROM t WHERE a = 'x' AND b = 'y z'"[:n]
        if sql.rstrip().endswith(("=", "AND", "'x", "'y", "'y z", "WHERE", "FROM", "SELECT")):
            assert pairs.statement_open(sql), sql


SCHEMA = "record_key long, messages array<struct<role:string,content:string>>, question string, answer string, defect string"
RESULTS = "result_key long, turn_index int, messages array<struct<role:string,content:string>>, reference_sql string"


def test_frames_with_nulls_long_texts_and_empty_tables(spark):
    records = spark.createDataFrame([
        (1, [("system", "s"), ("user", Q), ("assistant", SQL), ("user", Q), ("assistant", None)], "q", "a", "d"), (2, None, None, None, None), (3, [], None, None, None),
        (4, [("assistant", "x")], None, None, None), (5, [("user", None), (None, "z"), ("assistant", "word " * 50_000)], None, None, None), (1, [("user", Q), ("assistant", Q)], None, None, None),
    ], SCHEMA)
    results = spark.createDataFrame([(7, 2, [("user", Q)], None), (8, 0, None, SQL), (9, None, [], Q), (10, 1, [("user", Q)], "SELECT 'a" + "b" * 200_000)], RESULTS)
    got = {tuple(r[:4]) for r in pairs.flagged(pairs.all_pairs(records, results)).collect()}
    assert {("prepared_records", 1, 1, "empty"), ("prepared_records", 1, 0, "copy"), ("result_rows", 7, 2, "empty"), ("result_rows", 10, 1, "truncated")} <= got
    assert not any(r[1] in (2, 3, 8) for r in got)
    assert pairs.flagged(pairs.all_pairs(records.limit(0), results.limit(0))).count() == 0


@pytest.mark.parametrize("sql", ["SELECT name FROM clients WHERE age > 3; ", "```sql\nSELECT name FROM clients WHERE age > 3\n```\n"])
def test_prose_behind_the_statement_is_read(sql):
    question = "Which clients are older than three years, and how many of them are there?"
    german = "Diese Abfrage liefert alle Kunden, die älter als drei Jahre sind, und zeigt nur ihre Namen."
    english = "This query returns all of the clients that are older than three years, and shows only their names."
    assert pairs.defects_of(question, sql + german) == ["other_language"]
    assert pairs.defects_of(question, sql + english) == []
    assert pairs.defects_of(question, "SELECT name FROM clients; SELECT name FROM") == ["truncated"]
    assert pairs.defects_of(question, "```sql\nSELECT name FROM\n```\n" + english) == ["truncated"]
