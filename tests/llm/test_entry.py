"""The entry module where the subpackage is there but something that it imports is missing."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_entry_works_without_a_dependency(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('not installed')")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'op9_near_duplicates' in q, 'pipeline' in q, 'tfidf_by_class' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"})
    assert out.returncode == 0 and out.stdout.split()[1:] == ["False", "False", "True"], out.stderr
    assert "lexiqua.llm.registry is left out" in out.stderr
