"""The driver contract."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).resolve().parent


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 150


def test_library_stands_without_the_training_data_part(tmp_path):
    """A copy without the subpackage, its tests, and with or without the pipeline still gives every other query."""
    for drop in ([], ["corpus_pipeline.py"]):
        copy = tmp_path / f"copy{len(drop)}"
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json"))
        for name in drop:
            (copy / name).unlink(missing_ok=True)
        code = "import __spark_entry__ as e, tessera.service; q = e.queries(); assert 'semantic_topk' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
