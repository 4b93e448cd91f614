import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from spectraloom.plans.session import local_session

    return local_session()


@pytest.fixture
def split_plans(spark):
    """Force the plans for hot keys and long series on small data."""
    names = {"spectraloom.hotRows": "20", "spectraloom.blockRows": "16", "spectraloom.smallRows": "3", "spectraloom.packedSeries": "50"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)
