import unicodedata

import pytest
from pyspark.sql import functions as F

from sparlance.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


c = F.col


@pytest.mark.parametrize("text", ["Café  Müller!", "ÅNGSTRÖM-9", "naïve ​ x", "ß ø", "", " - ", "Ḁb"])
def test_normal_form_matches_the_definition(spark, text):
    want = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    want = " ".join("".join(ch if ch.isalnum() else " " for ch in want).split())
    assert one(spark, T.normalize_token(c("s")), s=text) == want == one(spark, T.normalize_token_full(c("s")), s=text)


def test_aliases_and_ids(spark):
    assert one(spark, T.aliases_of(c("s"), T.normalize_token(c("s"))), s="FR ") == ["FR", "fr"]
    assert one(spark, T.aliases_of(c("s"), T.normalize_token(c("s"))), s="fr") == ["fr"]
    assert len(one(spark, T.entry_id(c("s"), c("s")), s="x")) == 16
    assert one(spark, T.column_tail(c("s")), s='"A".[Name]') == "name" and one(spark, T.table_hint(c("s")), s="T1.name") is None and one(spark, T.table_hint(c("s")), s="Dog.name") == "dog"


@pytest.mark.parametrize("raw, want", [
    ("Sure!\n```sql\nSELECT 1;\n```", "SELECT 1;"), ("The answer is select a from t; and more", "select a from t;"), ("SELECT a FROM t\nuser: next", "SELECT a FROM t"), ("no statement", "no statement"), ("WITH q AS (SELECT 1) SELECT * FROM q", "WITH q AS (SELECT 1) SELECT * FROM q"),
])
def test_extract_sql(spark, raw, want):
    assert one(spark, T.extract_sql(c("s")), s=raw) == want


def test_extract_for_the_brief_variant(spark):
    raw = "QUERY_BRIEF:\nselect the rows\nSQL:\nSELECT 2"
    assert one(spark, T.extract_generated_sql(c("s"), c("v")), s=raw, v="structured_brief_sql") == "SELECT 2"
    assert one(spark, T.extract_generated_sql(c("s"), c("v")), s="SELECT 3", v=None) == "SELECT 3"


def test_spacing_repairs(spark):
    assert one(spark, T.repair_spacing(c("s"), True), s="a > = 1 and b !  = 2 WHEREc") == "a >= 1 and b != 2 WHERE c"
    assert one(spark, T.clean_sql(c("s")), s="a > = 1 = = 2") == "a >= 1 == 2"


@pytest.mark.parametrize("text, value, want", [("Go to PARIS, now", "paris", "PARIS"), ("Parisian", "paris", None), ("a.b", "a.b", "a.b"), ("axb", "a.b", None), ("x", "", None), ("is it \\E ok", "\\E", "\\E"), (None, "x", None)])
def test_exact_mention(spark, text, value, want):
    assert one(spark, T.exact_mention(c("t"), c("v")), t=text, v=value) == want


def test_token_match_and_pruning(spark):
    assert one(spark, T.whole_token_match(c("t"), c("a")), t="new york city", a="york") is True
    assert one(spark, T.whole_token_match(c("t"), c("a")), t="new yorker", a="york") is False and one(spark, T.whole_token_match(c("t"), c("a")), t="x", a="") is False
    assert [one(spark, T.prunable_alias(c("a")), a=a) for a in ("it", "the", "7", "4.5", "cat")] == [True, True, False, False, False]


def test_lists_usage_and_identifiers(spark):
    assert one(spark, T.top_level_parts(c("s")), s="a, f(b, c) , ,d") == ["a", "f(b, c)", "d"]
    assert one(spark, T.json_list(F.array(c("s"), F.lit("b"))), s='a"\\') == '["a\\"\\\\","b"]'
    assert one(spark, T.token_usage(c("p"), c("q"), c("t").cast("int")), p=1, q=2, t=None) == 3
    assert one(spark, T.normalize_identifier(c("s")), s=' `My  Col` ') == "my col" and one(spark, T.squeeze(c("s"), False), s=" A  b ") == "A b"
    assert sorted(one(spark, T.quoted_literals(c("s")), s="'a' \"b\" 'a'")) == ['"b"', "'a'"]
