import datetime as dt

import pytest
from pyspark.sql import functions as F

from paisaflow.functions import times
from paisaflow.sources.gateway import from_epoch


@pytest.fixture
def far_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("text, want", [
    ("2025-03-09T02:30:00", dt.datetime(2025, 3, 9, 2, 30)),
    ("09/03/2025 02:30:00", dt.datetime(2025, 3, 9, 2, 30)),
    (" 2025-03-09 02:30:00 ", dt.datetime(2025, 3, 9, 2, 30)),
    ("9/3/2025", dt.datetime(2025, 3, 9)), ("2025-03-09", dt.datetime(2025, 3, 9)),
    ("2025-03-09T02:30:00+05:30", dt.datetime(2025, 3, 9, 2, 30)),
    ("31/02/2025", None), ("2025", None), ("soon", None), ("", None),
])
def test_export_formats_in_any_zone(far_zone, text, want):
    df = far_zone.createDataFrame([(text,)], "t string")
    assert df.select(times.parse_export_timestamp(F.col("t"))).first()[0] == want


def test_hours_over_a_clock_change(far_zone):
    df = far_zone.createDataFrame(
        [("2025-03-09T00:00:00", "2025-03-09T06:30:00")], "a string, b string"
    ).select(times.parse_naive(F.col("a")).alias("a"), times.parse_naive(F.col("b")).alias("b"))
    row = df.select(
        times.hours_between(F.col("a"), F.col("b")), times.plus_days(F.col("a"), F.lit(0.5)),
        from_epoch(F.lit(1741500000)), times.is_weekend_or_holiday(F.col("a")),
    ).first()
    assert tuple(row) == (
        6.5, dt.datetime(2025, 3, 9, 12), dt.datetime(2025, 3, 9, 6), True
    )


def test_holiday(spark):
    df = spark.createDataFrame([("2025-08-15T09:00:00",), ("2025-08-14T09:00:00",)], "t string")
    got = [r[0] for r in df.select(
        times.is_weekend_or_holiday(times.parse_naive(F.col("t")))
    ).collect()]
    assert got == [True, False]
