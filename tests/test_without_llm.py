"""The rest stands without the folders of the training-data operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_them(tmp_path):
    def skip(folder, names):
        return {n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")}

    shutil.copytree(REPO, tmp_path / "r", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'latest_groups' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True)


def test_nothing_else_imports_them():
    for top, _, names in os.walk(os.path.join(REPO, "marlow")):
        if f"{os.sep}llm" not in top:
            for n in names:
                if n.endswith(".py"):
                    assert "marlow.llm" not in open(os.path.join(top, n)).read()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
