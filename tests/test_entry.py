import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_queries_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "hybrid_search_topk" in e.queries()


def test_entry_without_the_llm_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "recallum"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    if (llm := tmp_path / "recallum" / "llm").exists():  # gone where the subpackage isn't installed
        llm.rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50; assert not any(k.startswith('op1') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
