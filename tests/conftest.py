import os
import sys
import tempfile

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from skein.session import SCALE_CONF
    b = (SparkSession.builder.master("local[4]").appName("skein-tests")
         .config("spark.sql.shuffle.partitions", "4"))
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    # Tests name their own checkpoint folder (a cluster names a shared one).
    b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="skein-test-ckpt-"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from scripts.check_oracle import duck
    return duck(SF_SMALL)


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="skein-test-")


def duck_rows(con, sql):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def one_column(spark, values, name="t", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


__all__ = ["SF_SMALL", "SF_CHECK", "duck_rows", "one_column", "duckdb"]
