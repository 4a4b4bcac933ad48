"""The entry module stands without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

from hitledger.plans import all_queries

HERE = Path(__file__).resolve().parents[1]
LISTED = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), set(s) <= set(q), 'pipeline' in q)"


def test_copy_without_the_llm_folders(tmp_path):
    shutil.copytree(HERE, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "corpus_pipeline.py"))
    # the pipeline's module alone must not bring the operators in
    (tmp_path / "copy" / "corpus_pipeline.py").write_text("raise RuntimeError('not to be imported without its operators')\n")
    out = subprocess.run([sys.executable, "-c", LISTED], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    own = all_queries()
    assert out.stdout.split() == [str(len(own)), str(sum(q.sql is not None for q in own.values())), "True", "False"]
