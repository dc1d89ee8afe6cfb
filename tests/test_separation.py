"""The library stands without its training-data package."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_package():
    outside = [p for p in (REPO / "docloom").rglob("*.py") if "llm" not in p.relative_to(REPO / "docloom").parts]
    assert outside and not [p for p in outside if re.search(r"docloom\.llm|from \.+llm|corpus_pipeline", p.read_text())]


def test_entry_points_without_the_package(tmp_path):
    for name in ("docloom", "__spark_entry__.py", "corpus_pipeline.py"):
        src = REPO / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif src.exists():
            shutil.copy(src, tmp_path / name)
    for more in (True, False):  # with the pipeline's file left behind, and without
        if not more:
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q) and not [k for k in q if k.startswith('op') or k == 'pipeline']"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
