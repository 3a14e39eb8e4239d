import importlib.util
import os


def _entry():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs_and_contracts(spark):
    mod = _entry()
    df = mod.entry(spark)
    assert df.count() >= 0 and "issue_type" in df.columns
    q, sql = mod.queries(), mod.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 40
