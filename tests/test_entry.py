import importlib
import sys

import __spark_entry__ as entry


def test_library_stands_without_the_training_data_package(monkeypatch):
    """Queries of the rest stay registered if the package and the pipeline can't be imported."""
    for name in list(sys.modules):
        if name.startswith("deltascope.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "deltascope.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    found = entry._optional("deltascope.llm.queries", "LLM_QUERIES", "LLM_ORACLES")
    assert found == [{}, {}] and entry._optional("corpus_pipeline", "QUERIES", "ORACLES") == [{}, {}]
    assert "diff_keyed" in importlib.import_module("deltascope.plans.registry").QUERIES
