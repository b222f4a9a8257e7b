import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(engine_spark):
    import __spark_entry__

    df = __spark_entry__.entry(engine_spark)
    assert df.columns == ["nation", "orders", "revenue"] and df.count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_text_operators(tmp_path):
    for name in ("quiverql", "__spark_entry__.py"):
        source = f"{ROOT}/{name}"
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'nation_revenue' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
