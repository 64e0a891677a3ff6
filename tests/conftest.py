import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from streamlens.session import local_session

    s = local_session("8")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def chunks(spark):
    """Set the size above which a stream is cut; reset afterwards."""
    def set_size(n):
        spark.conf.set("spark.streamlens.chunkRows", str(n))

    yield set_size
    spark.conf.unset("spark.streamlens.chunkRows")
