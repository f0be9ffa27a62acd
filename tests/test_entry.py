import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) > 40


def test_entry_without_optional_parts(tmp_path):
    """The rest imports and registers its queries when the optional folders are gone."""
    for part in ("gossamer", "__spark_entry__.py"):
        source = os.path.join(REPO, part)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / part)
    shutil.rmtree(tmp_path / "gossamer" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pii_spans' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
