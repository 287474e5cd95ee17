"""Every query of the first part: against its SQL where there is one, else that it runs and has rows."""

import pytest

from patchlens.plans import queries as Q
from patchlens.plans import sql

from .compare import assert_same, connection
from .conftest import SF

ORACLE = sql.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(name, spark, con):
    df = Q.queries()[name](spark, SF)
    if name in ORACLE:
        assert_same(df, ORACLE[name], con)
    else:
        assert df.count() > 0


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(Q.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(tmp_path):
    """A copy without the corpus operators still imports, and has the first part's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "patchlens", tmp_path / "patchlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries(); print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(Q.queries())), str(len(ORACLE))], done.stderr
