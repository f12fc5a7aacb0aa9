"""The entry file without the training-data part."""

import importlib
import sys

import pytest


class Hidden:
    """Import finder that hides modules by name, with all below them."""

    def __init__(self, *names):
        self.names = names

    def find_spec(self, name, path=None, target=None):
        if any(name == n or name.startswith(n + ".") for n in self.names):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


@pytest.fixture
def entry_without(monkeypatch):
    def make(*names):
        for loaded in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("millpond.llm")]:
            monkeypatch.delitem(sys.modules, loaded)
        import millpond

        monkeypatch.delattr(millpond, "llm", raising=False)
        monkeypatch.setattr(sys, "meta_path", [Hidden(*names), *sys.meta_path])
        return importlib.import_module("__spark_entry__")

    return make


@pytest.mark.parametrize("gone", [("millpond.llm",), ("corpus_pipeline", "millpond.llm")])
def test_other_queries_work_without_the_training_data_part(entry_without, gone):
    entry = entry_without(*gone)
    found = entry.queries()
    assert "spending_trend" in found and set(entry.oracle_sql()) <= set(found)
    assert not [n for n in found if n == "pipeline" or (n.startswith("op") and n[2].isdigit())]


def test_a_library_missing_to_the_operators_is_an_error(entry_without):
    pytest.importorskip("millpond.llm")
    entry = entry_without("millpond.llm.common")
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
