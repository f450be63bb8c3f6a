import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tidebar-tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bars_of(spark):
    """Grid bars of one session from {slot: (open, high, low, close)}; other slots are missing."""
    import datetime as dt

    def make(prices, slots=30, base=100.0, fill=True, session=dt.date(2024, 1, 2), symbol="X"):
        rows = []
        for k in range(slots):
            p = prices.get(k, (base,) * 4 if fill else None)
            p = tuple(map(float, p)) if p else None
            rows.append((symbol, session, k, *(p if p else (None,) * 4), 1.0 if p else None, slots, True))
        return spark.createDataFrame(rows, "symbol string, session date, slot int, open double, high double, low double, close double, volume double, close_slot int, is_normal boolean")
    return make
