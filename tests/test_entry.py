"""The driver's entry points, with and without the llm folders."""

import subprocess
import sys

import __spark_entry__


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).columns == ["source_id", "action", "target_id", "changed", "warning"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_llm(tmp_path):
    import pathlib
    import shutil

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "tandem", tmp_path / "tandem", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
