import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import session

    tmp = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(tmp / "warehouse"), "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data here")
    return d


@pytest.fixture(scope="session")
def compare(spark, sf):
    """A query's rows against its SQL's, as sorted text."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def go(query, sql):
        df = query(spark, sf)
        mine = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
        rel = con.sql(sql)
        order = sorted(rel.columns)
        assert order == sorted(df.columns)
        at = [rel.columns.index(c) for c in order]
        theirs = [tuple(r[i] for i in at) for r in rel.fetchall()]
        assert sorted(map(repr, mine)) == sorted(map(repr, theirs))

    return go
