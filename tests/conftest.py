import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from adlift.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8, app_name="adlift-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from adlift.sources.mapped import campaign_tables
    return campaign_tables(spark, SF)
