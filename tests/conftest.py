import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weftgrid.session import build_session

    session = build_session(
        "tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="6g",
        spark_ui_showConsoleProgress="false", spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def forced_skew(spark):
    """No broadcasts, and skew splitting at sizes a test can reach."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in changed if spark.conf.get(k, None) is not None}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k in changed:
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)
