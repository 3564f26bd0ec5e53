import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from churnlens.session import get_spark
    s = get_spark("local[4]", 8, app="churnlens-tests", extra={"spark.driver.memory": "8g"})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="churnlens-test-ckpt-"))
    yield s


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="churnlens-test-")
