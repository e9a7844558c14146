"""The entry points work, with or without the llm folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracles_name_queries():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and len(queries) > 50


def test_entry_without_llm(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'item_bank_report' in q and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 40


def test_flagship(spark):
    import __spark_entry__

    if not os.path.isdir("/root/testdata/sf0.001"):
        import pytest

        pytest.skip("no test data here")
    assert __spark_entry__.entry(spark).columns == ["split", "n", "rmse_b", "mae_b", "rmse_p", "pearson"]
