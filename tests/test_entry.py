import importlib

import __spark_entry__ as entry


def test_queries_and_sql_agree_on_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_llm_imports_it():
    import pathlib

    root = pathlib.Path(importlib.import_module("helixframe").__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "helixframe.llm" not in path.read_text()


def test_the_flagship_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
