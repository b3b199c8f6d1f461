import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def at(text):
    """A UTC instant from 'YYYY-MM-DD HH:MM[:SS]'."""
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def make(spark):
    """Samples from short tuples (user, metric, value, start[, end, device, metadata])."""
    from pulseframe.schema import SAMPLES

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            user, metric, value, start, *rest = r
            end, device, metadata = (list(rest) + [None] * 3)[:3]
            full.append((user, metric, None if value is None else float(value), "u", device or "Oura Ring", at(start),
                         at(end) if end else None, metadata, i))
        return spark.createDataFrame(full, SAMPLES)

    return build


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
