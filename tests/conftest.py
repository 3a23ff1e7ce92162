import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same():
    """Compares a Spark result with its DuckDB twin, in any order."""
    import duckdb

    def norm(v):
        if isinstance(v, float):
            return round(v, 5)
        return tuple(norm(x) for x in v) if isinstance(v, list | tuple) else v

    def check(spark, d, query, sql):
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
        df = query(spark, d)
        cols = sorted(df.columns)
        mine = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
        names = ", ".join(f'"{c}"' for c in cols)
        theirs = sorted((tuple(norm(x) for x in r) for r in con.execute(f"select {names} from ({sql.strip()})").fetchall()), key=repr)
        assert mine == theirs

    return check
