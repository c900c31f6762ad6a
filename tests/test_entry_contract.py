"""The driver contract: keys line up, every query of the library's own has an oracle, imports are cheap."""
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_keys_line_up():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    from quarry.plans.driver import QUERIES
    assert set(QUERIES) <= set(oracles) and set(QUERIES) <= set(queries)
    assert all(isinstance(sql, str) and sql.strip() for sql in oracles.values())


def test_oracles_import_without_a_session():
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as e; "
            "print(len(e.oracle_sql()), len(e.queries()))" % str(ROOT))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/tmp",
                         timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    n_oracles, n_queries = map(int, out.stdout.split()[-2:])
    assert 43 <= n_oracles <= n_queries
