import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import get_spark

    s = get_spark("tests", cpus=os.environ.get("TEST_CPUS", "8"), shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def normal(rows):
    """Rows as sortable text: floats to nine digits."""
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Run a query and its SQL twin and compare names and rows."""

    def check(query, sql):
        df = query(spark, sf)
        names = sorted(df.columns)
        rows = [tuple(r[n] for n in names) for r in df.collect()]
        got = duck.execute(sql)
        theirs = [x[0] for x in got.description]
        assert sorted(theirs) == names
        at = [theirs.index(n) for n in names]
        assert normal(rows) == normal([tuple(r[i] for i in at) for r in got.fetchall()])
        return len(rows)

    return check
