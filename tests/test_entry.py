import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)


def test_works_without_the_llm_subpackage(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    import shutil

    shutil.copytree(ROOT / "citewell", tmp_path / "citewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "citewell").rglob("*.py"):
        if "llm" not in path.parts:
            assert "citewell.llm" not in path.read_text(), path
