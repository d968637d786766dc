"""The registered queries without the training-data part."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", [False, True])
def test_entry_imports_without_the_training_data_part(tmp_path, left):
    """Also if a folder of compiled files is left where the subpackage was."""
    for path in ROOT.rglob("*.py"):
        part = path.relative_to(ROOT)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py" and part.parts[0] in ("leakscope", "__spark_entry__.py"):
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(path.read_text())
    if left:
        (tmp_path / "leakscope" / "llm" / "__pycache__").mkdir(parents=True)
        (tmp_path / "corpus_pipeline.py").write_text((ROOT / "corpus_pipeline.py").read_text() if (ROOT / "corpus_pipeline.py").exists() else "import leakscope.llm.common")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 120 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
