import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_training_data_part(tmp_path):
    for name in ("__spark_entry__.py", "tallyfold"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tallyfold" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'daily_bars' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_training_data_part():
    for path in (REPO / "tallyfold").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "llm" not in path.read_text(), path


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
