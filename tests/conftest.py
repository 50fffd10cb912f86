import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidegrid.session import get_session

    return get_session()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (series, minutes, value) to a DataFrame with a timestamp_ntz column."""
    from pyspark.sql import functions as F

    def build(rows, ts="ts", value="value"):
        d = spark.createDataFrame([(s, float(m), None if v is None else float(v)) for s, m, v in rows], "series_id string, m double, v double")
        at = F.timestamp_micros((F.col("m") * 60_000_000).cast("long") + 1_704_067_200_000_000).cast("timestamp_ntz")
        return d.select("series_id", at.alias(ts), F.col("v").alias(value))

    return build
