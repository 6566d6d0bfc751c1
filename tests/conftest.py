import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from roomtide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, memory="4g")


@pytest.fixture(scope="session")
def t0():
    return datetime(2025, 1, 1)


@pytest.fixture(scope="session")
def at(t0):
    """Moment a number of minutes after the first of January 2025."""
    return lambda minutes: t0 + timedelta(minutes=minutes)


@pytest.fixture(scope="session")
def occ(spark):
    """Canonical occupancy frame from (timestamp, zone, count) rows."""
    return lambda rows: spark.createDataFrame(
        rows, "timestamp timestamp_ntz, zone_id string, occupancy_count double"
    )


@pytest.fixture(scope="session")
def weather(spark):
    return lambda rows: spark.createDataFrame(rows, "timestamp timestamp_ntz, outside_temp double")
