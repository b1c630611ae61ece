"""Every registered query against its DuckDB SQL on the driver's tables."""

import os

import pytest

from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_all_queries_match_oracle(spark):
    res = compare(spark, SF)
    bad = {k: v for k, v in res.items() if v["ok"] is False}
    assert not bad, bad
    assert sum(v["ok"] is True for v in res.values()) >= 50


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert df.columns == ["rule", "files", "bytes"]
    assert rows and any(r["rule"] == "Total" for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())
