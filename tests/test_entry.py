import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_works_without_the_llm_subpackage(tmp_path):
    import shutil

    for name in ("siltbed", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "siltbed" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_retrieve' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
