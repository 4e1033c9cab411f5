import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_queries_without_the_corpus_folders(tmp_path):
    ignore = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "spark-warehouse")
    shutil.copytree(REPO, tmp_path / "whole", ignore=ignore)
    for kept in (("corpus_pipeline.py",), ()):
        root = tmp_path / f"copy{len(kept)}"
        shutil.copytree(tmp_path / "whole", root, ignore=lambda _, names, kept=kept: {"corpus_pipeline.py"} - set(kept))
        code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()) and len(q) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code], cwd=root, env=env, check=True, timeout=120)
