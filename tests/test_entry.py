import importlib
import sys


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert "home_score_roll5_mean" in df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("scoreline.llm", "corpus_pipeline") else find(n, *a))
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as e

    assert "w1_rolling" in e.queries() and not any(n.startswith("op") for n in e.queries())


def test_entry_of_a_copy_that_lacks_the_corpus_folders(tmp_path):
    import os
    import shutil
    import subprocess

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "scoreline"), tmp_path / "scoreline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
