import importlib.util

import pytest

import __spark_entry__

WITH_LLM = importlib.util.find_spec("linkloom.llm") is not None


def test_queries_and_sql():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert "p2_found" in known
    assert ("p1_found" in known) == WITH_LLM


def test_core_doesnt_import_llm():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent / "linkloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "linkloom.llm" not in path.read_text()


def test_shared_folder_is_read_from_the_session(spark):
    from linkloom.runtime import shared_folder, written

    folder = shared_folder(spark)
    assert shared_folder(spark) == folder
    table = written(spark.range(3))
    assert table._linkloom_path.startswith(folder) and table.count() == 3


@pytest.mark.parametrize("name", ["linkloom", "linkloom.queries", "bench"])
def test_imports(name):
    assert importlib.import_module(name)
