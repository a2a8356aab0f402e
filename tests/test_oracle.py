"""Every registered query against its DuckDB SQL (the driver's check, locally)."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from oracle_check import compare


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["calls"] > 0


def test_registry_keys_match():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.parametrize("sf_dir", [SF_SMALL])
def test_all_queries_match_oracle(spark, sf_dir):
    res = compare(spark, sf_dir, verbose=False)
    bad = {k: v for k, v in res.items()
           if not (v.get("cols", True) and v.get("values", True)
                   and v["rows"] == v.get("oracle_rows", v["rows"]))}
    assert not bad, bad
