"""The library without its optional package."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert 'label_distribution' in q and not any(k.startswith('op') for k in q), q; print(len(q))"


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "no pipeline"])
def test_entry_without_the_optional_package(tmp_path, left):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json"))
    if left == "an empty folder":
        (copy / "logwarden/llm").mkdir()
    if left == "no pipeline":
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    run = subprocess.run(
        [sys.executable, "-c", CODE], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"},
        capture_output=True, text=True,
    )
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) > 70
