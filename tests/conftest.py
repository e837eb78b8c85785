import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


def same_rows(left, right):
    """Frames with equal columns and rows, in any order."""
    assert sorted(left.columns) == sorted(right.columns)

    def shown(frame):
        frame = frame[sorted(frame.columns)].copy()
        for c in frame.columns:
            frame[c] = [repr(round(float(x), 6)) if isinstance(x, float) else str(x) for x in frame[c].astype(object).where(frame[c].notna(), None)]
        return frame.sort_values(list(frame.columns)).reset_index(drop=True)

    a, b = shown(left), shown(right)
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head()
