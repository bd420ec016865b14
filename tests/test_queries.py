"""Every registered query against its SQL, and the registry without the optional subpackage."""

import os
import subprocess
import sys

import pytest

from marlstone.plans import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark".split()


def canon(x):
    return round(float(x), 6) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name].run(spark, SF)
    got = df.collect()
    if QUERIES[name].sql is None:
        return
    cur = con.execute(QUERIES[name].sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = cur.fetchall()
    assert sorted((tuple(canon(r[c]) for c in columns) for r in got), key=str) == sorted((tuple(map(canon, r)) for r in want), key=str)


def test_imports_without_session_and_without_llm(tmp_path):
    for name in ("marlstone", "__spark_entry__.py"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name)
    code = "import sys; sys.modules['marlstone.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not [q for q in e.queries() if q[2:3].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
