"""The time zone of a panel's periods.

Periods of a zoned index are instants. The zone's name is metadata of the column ts, which selections, filters, joins and
written tables keep, so that labels and the calendar are read in it, whatever the session's own zone is.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = "time_zone"


def zone_of(df: DataFrame) -> str | None:
    """The zone in which ts is to be read: its own, the session's for instants without one, None for wall times."""
    if dict(df.dtypes)["ts"] == "timestamp_ntz":
        return None
    return df.schema["ts"].metadata.get(_KEY) or df.sparkSession.conf.get("spark.sql.session.timeZone")


def with_zone(df: DataFrame, zone: str | None) -> DataFrame:
    return df if zone is None or dict(df.dtypes)["ts"] == "timestamp_ntz" else df.withMetadata("ts", {_KEY: zone})


def wall_time(ts: Column, zone: str | None) -> Column:
    """What clocks in the zone show at an instant, as timestamp_ntz; wall times stay."""
    if zone is None:
        return ts.cast("timestamp_ntz")
    seconds = (F.unix_micros(F.from_utc_timestamp(ts, zone)) / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def at(moment: str | datetime | pd.Timestamp, zone: str | None) -> Column:
    """A moment as a literal that ts can be compared with: a wall time of the zone if it has no zone of its own. Of an hour that clocks show twice it is the first; one that they skip counts as the next."""
    stamp = pd.Timestamp(moment)
    if zone is None:
        return F.lit(str(stamp.tz_localize(None))).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(localized(stamp, zone).value // 1000))


def localized(stamp: pd.Timestamp, zone: str) -> pd.Timestamp:
    return stamp if stamp.tz is not None else stamp.tz_localize(zone, ambiguous=True, nonexistent="shift_forward")
