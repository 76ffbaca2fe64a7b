import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparlance.llm import copies

SAME = [
    ("SELECT a, b FROM t", "select b ,a\nfrom T;"),
    ("SELECT a FROM t WHERE x='A b'", "select `a` from [t] where \"x\" = 'A b' ; ;"),
    ("SELECT DISTINCT a, COUNT(b, c) FROM t", "select distinct count(b,c),a from t"),
    ("SELECT a FROM t WHERE x ! = 3", "SELECT a FROM t WHERE x != 3"),
    ("SELECT (SELECT x FROM u), b FROM t", "SELECT b, (SELECT x FROM u) FROM t"),
    ("update t set a = 1", "UPDATE T SET A=1;"),
]
OTHER = [
    ("SELECT a FROM t WHERE x='A'", "SELECT a FROM t WHERE x='a'"),
    ("SELECT a FROM t WHERE x='A  b'", "SELECT a FROM t WHERE x='A b'"),
    ("SELECT a, b FROM t GROUP BY a, b", "SELECT a, b FROM t GROUP BY b, a"),
    ("SELECT a FROM t", "SELECT DISTINCT a FROM t"),
    ("SELECT a FROM t WHERE x='it''s; B", "SELECT a FROM t WHERE x='it''s; b"),
    ("SELECT a FROM t WHERE x = 1", "SELECT a FROM t WHERE x <> 1"),
    ("SELECT a FROM t; SELECT b", "SELECT a FROM t SELECT b"),
    ("SELECT a, 'x,Y' FROM t", "SELECT a, 'x,y' FROM t"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_equal_forms(a, b):
    assert copies.canonical_statement(a) == copies.canonical_statement(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_different_forms(a, b):
    assert copies.canonical_statement(a) != copies.canonical_statement(b)


def slow_form(s):
    """The same definition, written character by character."""
    out, quoted, i = [], False, 0
    while i < len(s):
        c = s[i]
        if quoted:
            if c == "'" and s[i + 1 : i + 2] == "'":
                out.append(("lit", "''"))
                i += 2
                continue
            quoted = c != "'"
            out.append(("lit", c))
        elif c == "'":
            quoted = True
            out.append(("lit", c))
        elif c.isspace() or c in '`"[]':
            out.append(("gap", ""))
        else:
            out.append(("ch", c.lower()))
        i += 1
    while out and (out[-1] == ("ch", ";") or out[-1][0] == "gap"):
        out.pop()
    text = "".join(("\x01" + v if k == "lit" else v if k == "ch" else "\x02") for k, v in out)
    m = re.match("\x02*select\\b((?:\x02+distinct\\b)?)", text)
    if m:
        depth, i, parts, cur = 0, m.end(), [], ""
        while i < len(text):
            if depth <= 0 and re.match(r"from\b", text[i:]) and not re.match(r"\w", text[i - 1]):
                items = sorted(p.replace("\x02", "") for p in [*parts, cur])
                text = "select" + m.group(1) + ",".join(items) + text[i:]
                break
            if text[i] == "\x01":
                cur += text[i : i + 2]
                i += 2
                continue
            depth += (text[i] == "(") - (text[i] == ")")
            if text[i] == "," and depth <= 0:
                parts.append(cur)
                cur = ""
            else:
                cur += text[i]
            i += 1
    return text.replace("\x02", "").replace("\x01", "")


PIECES = st.lists(st.sampled_from(["SELECT ", "select ", "a", "b ", ", ", ",", "(", ")", " FROM ", "from", "'x Y'", "'it''s'", "'open", ";", " ", "\n", "`", '"', "[", "]", " = ", "DISTINCT ", "'A,b'"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES)
def test_groups_match_slow_definition(x, y):
    a, b = "SELECT " + "".join(x), "SELECT " + "".join(y)
    if (copies.canonical_statement(a) == copies.canonical_statement(b)) != (slow_form(a) == slow_form(b)):
        raise AssertionError((a, b, copies.canonical_statement(a), slow_form(a), slow_form(b)))


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_changed_layout_is_still_a_copy(x):
    a = "SELECT " + "".join(p for p in x if "'" not in p) + " FROM t"
    b = a.upper().replace(" ", "\n\t") + " ;"
    assert copies.canonical_statement(a) == copies.canonical_statement(b)


SCHEMA = "result_key long, reference_sql string, key string, digest int, n int"


def rows(spark, pairs):
    return spark.createDataFrame([(k, s, "k", 1, 2) for k, s in pairs], SCHEMA)


def test_groups_with_a_hot_key(spark):
    hot = [(i, f"select {'a, b' if i % 2 else 'b,a'} from t") for i in range(600)]
    rest = [(1000 + i, f"select c{i // 2} from t;{';' * (i % 2)}") for i in range(600)]
    got = copies.hidden_copies(rows(spark, hot + rest)).collect()
    want = {(0, i) for i in range(1, 600)} | {(1000 + i, 1001 + i) for i in range(0, 600, 2)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    n = Counter(r["n_rows"] for r in copies.distinct_statements(rows(spark, hot + rest)).collect())
    assert n == {600: 1, 2: 300}


def test_nulls_empties_ties_and_empty_tables(spark):
    df = rows(spark, [(1, None), (2, ""), (3, "```sql\n```"), (4, " -- "), (5, "select a from t"), (5, "SELECT A FROM T"), (6, "x" * 300_000), (7, "X" * 300_000), (None, "select a from t")])
    assert {tuple(r) for r in copies.hidden_copies(df).collect()} == {(6, 7)}
    assert copies.hidden_copies(rows(spark, [])).count() == 0
    assert copies.distinct_statements(rows(spark, [(1, None)])).count() == 0


def test_hot_groups_are_salted_by_their_number_of_rows(spark, monkeypatch):
    rows = [(i, "SELECT a FROM t" if i % 3 else f"SELECT {i % 5} FROM t") for i in range(300)]
    df = spark.createDataFrame(rows, "result_key long, reference_sql string")
    want = {}
    for k, s in rows:
        first, n = want.get(s, (k, 0))
        want[s] = (min(first, k), n + 1)
    for few in (copies.FEW_HOT, 0):
        monkeypatch.setattr(copies, "FEW_HOT", few)
        got = copies.copy_groups(df, hot=7).collect()
        assert len(got) == 300 and {(r["key"], r["first_key"], r["n_rows"]) for r in got} == {(k, *want[s]) for k, s in rows}
