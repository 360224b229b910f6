import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LOADED = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'topk' in q and set(s) <= set(q); print(sum(x == 'pipeline' or x[2:3].isdigit() for x in q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_engine_stands_alone(tmp_path, pipeline):
    """Without the training-data operators, with or without the pipeline's file, the other queries load."""
    ignored = shutil.ignore_patterns("llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=ignored)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(ROOT / name, tmp_path)
    done = subprocess.run([sys.executable, "-c", LOADED], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "0"


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tidemark.llm" not in path.read_text(), path
