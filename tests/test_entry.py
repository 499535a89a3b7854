"""The entry works without the corpus operators, and hides no other missing module."""

import importlib.util
import sys
from pathlib import Path

import pytest

ENTRY = Path(__file__).resolve().parent.parent / "__spark_entry__.py"


def load():
    spec = importlib.util.spec_from_file_location("entry_copy", ENTRY)
    made = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(made)
    return made


def without(monkeypatch, name):
    for loaded in list(sys.modules):
        if loaded == "corpus_pipeline" or loaded.startswith("quillgraph.llm"):
            monkeypatch.delitem(sys.modules, loaded)
    monkeypatch.setitem(sys.modules, name, None)


def test_without_the_subpackage(monkeypatch):
    without(monkeypatch, "quillgraph.llm")
    entry = load()
    assert "pipeline" not in entry.queries() and entry.queries().keys() == entry.oracle_sql().keys()


def test_other_missing_modules_are_errors(monkeypatch):
    if not (ENTRY.parent / "quillgraph/llm").is_dir():
        pytest.skip("the subpackage is not here")
    without(monkeypatch, "numpy")
    with pytest.raises(ModuleNotFoundError, match="numpy"):
        load()


def test_all_queries_are_there():
    entry = load()
    if (ENTRY.parent / "quillgraph/llm").is_dir():
        assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in entry.queries() if n.startswith("op")} and "pipeline" in entry.queries()
