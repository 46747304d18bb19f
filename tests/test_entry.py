"""The driver contract: entry(), queries() and oracle_sql()."""

import importlib.util
import os


def _load():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry_under_test", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    m = _load()
    df = m.entry(spark)
    cols = df.columns
    assert df.count() > 0
    assert m.entry(spark).columns == cols
    assert {"pkt_no", "split", "label"} <= set(cols)
    assert all(c + "_norm" in cols for c in ("f01_ip_time_interval", "f09_tcpudp_length_changes"))
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80
    assert sum(name.startswith("q_") for name in q) >= 80
    assert all(callable(fn) for fn in q.values())
