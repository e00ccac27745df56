"""Every engine query runs, and gives what its SQL gives."""

from __future__ import annotations

import importlib
import sys

import pytest

from riverbed import catalog
from support import ORACLE, SMALL, compare


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_engine_query(spark, name):
    if sql := catalog.oracle_sql().get(name):
        compare(spark, catalog.QUERIES[name], sql, ORACLE)
    else:
        assert catalog.QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.queries()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["event_id", "client_id", "query_ids"] and df.limit(1).collect()


def test_entry_without_the_corpus_part(monkeypatch):
    """With the subpackage and the pipeline gone, the rest stays."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("riverbed.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for n in [n for n in sys.modules if n in ("corpus_pipeline", "__spark_entry__") or n.startswith("riverbed.llm")]:
        monkeypatch.delitem(sys.modules, n)
    import riverbed

    monkeypatch.delattr(riverbed, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    e = importlib.import_module("__spark_entry__")
    assert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracle_sql())
    sys.modules.pop("__spark_entry__")
