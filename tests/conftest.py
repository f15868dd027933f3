import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sparkroll.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="8g", app="sparkroll-tests")


@pytest.fixture
def split_plans(spark):
    """Every group of more than two rows counts as hot, so the split plans run."""
    spark.conf.set("spark.sparkroll.hotGroupRows", "2")
    yield
    spark.conf.unset("spark.sparkroll.hotGroupRows")
