"""The entry module with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", [(), ("lakeloom/llm/__pycache__/x.pyc",), ("lakeloom/llm/__pycache__/x.pyc", "corpus_pipeline.py")])
def test_without_the_operators(tmp_path, left):
    """Their folder may be gone as a whole or leave caches behind."""
    shutil.copytree(ROOT / "lakeloom", tmp_path / "lakeloom", ignore=lambda folder, names: {"llm", "__pycache__"} & set(names))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for name in left:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) == 23 and 'pipeline' not in e.queries()"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
