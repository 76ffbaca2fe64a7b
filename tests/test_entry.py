import importlib
import sys
from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"


def test_names_and_oracles_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


def test_core_does_not_need_the_training_package(monkeypatch):
    root = Path(__file__).resolve().parents[1] / "sparlance"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "sparlance.llm" not in p.read_text()
    monkeypatch.setitem(sys.modules, "sparlance.llm", None)
    monkeypatch.setitem(sys.modules, "sparlance.llm.queries", None)
    import __spark_entry__ as e

    again = importlib.reload(e)
    assert again.training is None and not any(n.startswith("p1_") for n in again.queries())
    monkeypatch.undo()
    importlib.reload(e)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
def test_flagship_query(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["customer_segment", "revenue"] and df.count() == 5


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["run_metrics", "alias_retrieval_topk", "expand_turns", "semantic_text", "pairwise_fixed_regressed", "split_integrity", "value_index_part", "mention_status"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for f in Path(SMALL).iterdir():
        con.execute(f"create view {f.name.split('.')[0]} as select * from read_parquet('{f}')")
    df = e.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    mine = sorted(str([r[c] for c in cols]) for r in df.collect())
    got = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in got.description]
    theirs = sorted(str([r[names.index(c)] for c in cols]) for r in got.fetchall())
    assert sorted(names) == cols and mine == theirs
