from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tideline.session import local_session

    session = local_session("tideline-tests", shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Slices of about 60 rows, so that keys cross them on small data."""
    spark.conf.set("tideline.slice.rows", "60")
    yield spark
    spark.conf.unset("tideline.slice.rows")
