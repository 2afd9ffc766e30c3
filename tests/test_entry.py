"""The entry point goes on without the training-data folder, or without something that it needs."""

import importlib

import __spark_entry__ as entry
from frostline import catalog


def test_queries_without_a_dependency(monkeypatch, capsys):
    real = importlib.import_module

    def missing(name, *rest):
        if name.startswith("frostline.llm"):
            raise ModuleNotFoundError("No module named 'ahocorasick'")
        return real(name, *rest)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert entry.queries().keys() == catalog.QUERIES.keys() and entry.oracle_sql().keys() == catalog.ORACLE_SQL.keys()
    assert "ahocorasick" in capsys.readouterr().err


def test_every_oracle_has_its_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
