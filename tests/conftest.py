import os
import sys
import time

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["TZ"] = "UTC"
time.tzset()

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from txnrecon.plans import session
    from txnrecon.streaming.alerts import ROCKSDB

    spark = session.local("tests", 8, shuffle_partitions=4, memory="6g")
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def value(spark):
    """Evaluate one Column over literal inputs."""
    from pyspark.sql import functions as F

    def run(build, *inputs):
        frame = spark.range(1).select(*[F.lit(v).alias(f"c{i}") for i, v in enumerate(inputs)])
        cols = [F.col(f"c{i}") for i in range(len(inputs))]
        return frame.select(build(*cols).alias("r")).collect()[0][0]

    return run
