import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_contract():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 30 and all(callable(f) for f in q.values())


def test_core_does_without_llm():
    code = "import sys; sys.modules['spanloom.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(k.startswith(('p1_', 'p2_')) for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO).returncode == 0


def test_entry(spark):
    import __spark_entry__ as entry

    if Path(SMALL).exists():
        assert entry.entry(spark).count() > 0
