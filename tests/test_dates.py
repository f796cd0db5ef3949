import pytest
from helpers import by
from pyspark.sql import functions as F

from feedtide.functions import feed_date_text, stamp_to_timestamp
from feedtide.functions.dates import display_date
from feedtide.params import Params, parse_duration

DATES = {
    "Sat, 03 Feb 2024 08:05:00 GMT": "2024-02-03T08:05:00Z",
    "Sat, 3 Feb 2024 08:05 +0130": "2024-02-03T06:35:00Z",
    "3 February 24 8:05:09 EST": "2024-02-03T13:05:09Z",
    "03 Feb 1999 08:05:00 Z": "1999-02-03T08:05:00Z",
    "03 Feb 2024": "2024-02-03T00:00:00Z",
    "2024-02-03T08:05:00.987Z": "2024-02-03T08:05:00Z",
    "2024-02-03T08:05:00+02:00": "2024-02-03T06:05:00Z",
    "2024-02-03T08:05-0300": "2024-02-03T11:05:00Z",
    "2024-02-03": "2024-02-03T00:00:00Z",
    "2024-02": "2024-02-01T00:00:00Z",
    "31 Feb 2024 08:05:00 GMT": None,
    "yesterday": None,
    "08:05": None,
    "": None,
    None: None,
}


def test_feed_dates(spark):
    df = spark.createDataFrame([(d,) for d in DATES], "d string")
    assert by(df.withColumn("t", feed_date_text(F.col("d"))), "d", "t") == DATES


def test_capture_stamps(spark):
    df = spark.createDataFrame([("20240203080509",), ("2024",), (None,)], "s string").select(
        "s",
        F.date_format(stamp_to_timestamp(F.col("s")), "HH:mm:ss").alias("t"),
        display_date(F.col("s")).alias("day"),
    )
    assert by(df, "s", "t") == {"20240203080509": "08:05:09", "2024": None, None: None}
    assert by(df, "s", "day")["20240203080509"] == "03/02/2024"


@pytest.mark.parametrize("text", ["90", "30s", "5m", "12h", "3d", "2w", "1M", "1y"])
def test_durations(text):
    Params(as_of="2024-01-01T00:00:00Z", recapture_window=text)


@pytest.mark.parametrize("text", ["", "h", "1.5h", "5 h", "5H", "-1d", "1d2h"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        Params(as_of="2024-01-01T00:00:00Z", recapture_window=text)


def test_minutes_and_months_differ(spark):
    start = F.lit("2024-01-31 00:00:00").cast("timestamp")
    row = spark.range(1).select(
        (start - parse_duration("1m")).cast("string").alias("m"),
        (start - parse_duration("1M")).cast("string").alias("M"),
        (start - parse_duration("90")).cast("string").alias("s"),
    ).first()
    assert tuple(row) == ("2024-01-30 23:59:00", "2023-12-31 00:00:00", "2024-01-30 23:58:30")
