import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from massloom.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", cores="8", shuffle=8)
    # Small inputs keep all their partitions, so that scans across several buckets are exercised.
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
