import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    from drawpool.session import RECOMMENDED_CONF
    ck = str(tmp_path_factory.mktemp("ckpt"))
    b = (SparkSession.builder.master("local[*]").appName("drawpool-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.checkpoint.dir", ck))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # the tests own this session: the shared state folder is a temp dir
    s.sparkContext.setCheckpointDir(ck)
    yield s
    s.stop()
