from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqyield.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    # The checkpoint folder comes from spark.checkpoint.dir when the environment names
    # one; build_session falls back to a fresh local folder only when it is unset.
    s = build_session("local[4]", app="seqyield-tests", shuffle_partitions=4,
                      conf={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="seqyield-test-")
