import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logtable.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores="4", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def assets(spark):
    from logtable.sources.assets import assets_frame, default_assets

    return assets_frame(spark, default_assets())
