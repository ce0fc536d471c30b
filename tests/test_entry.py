import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_rest_works_without_the_llm_folders(tmp_path):
    """Neither the package nor the entry module needs the training-data operators."""
    shutil.copytree(f"{ROOT}/gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) >= 60 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["geo", "period", "revenue", "quantity", "avg_price"]
