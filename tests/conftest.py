import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from floodspark.session import build_session
    s = build_session("local[4]", app="floodspark-tests", shuffle_partitions=4,
                      extra={"floodspark.frames.blockRows": "7"})
    yield s
    s.stop()


@pytest.fixture()
def small_blocks(spark):
    """Tiny frame blocks, so that the halo and two-level scans are exercised."""
    old_b = spark.conf.get("floodspark.frames.blockRows", None)
    spark.conf.set("floodspark.frames.blockRows", "5")
    yield spark
    spark.conf.set("floodspark.frames.blockRows", old_b or "7")
