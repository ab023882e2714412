"""Time rules: stored text stamps, the weekly session of currency markets, daylight-saving cells, periods, gap classes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stamps are text of 30 characters in UTC.
STORED = "yyyy-MM-dd'T'HH:mm:ss'.000000000Z'"
NEW_YORK, LONDON = "America/New_York", "Europe/London"
#: The last bar of a week opens on Friday at 16:00 and trade reopens on Sunday at 17:00, New York time.
LAST_HOUR, REOPEN_HOUR = 16, 17


def stored(ts: Column) -> Column:
    """A timestamp as stored text; fractions of a second are cut."""
    return F.date_format(ts.cast("timestamp_ntz"), STORED)


def parse_iso(text: Column) -> Column:
    """ISO text with an offset or Z to a timestamp; more than six digits of a fraction are cut; null without an offset."""
    cut = F.regexp_replace(text, r"(\.[0-9]{6})[0-9]+", "$1")
    return F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(cut))


def parse_stored(text: Column) -> Column:
    """Stored text to epoch seconds; null unless it has exactly that form."""
    ok = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.000000000Z$")
    return F.when(ok, F.unix_timestamp(F.try_to_timestamp(F.concat(F.substring(text, 1, 19), F.lit("Z")))))


def normal_bound(text: Column) -> Column:
    """Any ISO text with an offset as stored text; stored text stays as it is."""
    return F.coalesce(F.when(parse_stored(text).isNotNull(), text), stored(F.to_utc_timestamp(F.from_utc_timestamp(parse_iso(text), "UTC"), "UTC")))


def offset_hours(ts: Column, zone: str) -> Column:
    """Hours that the zone is ahead of UTC at a UTC timestamp."""
    return F.timestamp_diff("HOUR", ts, F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz"))


def dst_cell(ts: Column) -> Column:
    """Which of London and New York have summer time; London's alone is counted as New York's winter."""
    uk, us = offset_hours(ts, LONDON) == 1, offset_hours(ts, NEW_YORK) == -4
    return F.when(uk & us, "both_summer").when(us, "uk_winter_us_summer").when(uk, "uk_summer_us_winter").otherwise("both_winter")


def local_view(ts: Column, zone: str) -> Column:
    """A UTC timestamp as text in a zone, to the minute."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyyy-MM-dd HH:mm")


def hour_classes(ts: Column) -> Column:
    """The classes that a bar's hour is in, one or more: all, flat (8 to 15), rollover_ny and adjacent_ny (around 17:00 in New York, by its daylight-saving cell), utc21_legacy."""
    hour, winter = F.hour(ts), dst_cell(ts).isin("both_winter", "uk_summer_us_winter")
    off = F.pmod(hour - F.when(winter, 22).otherwise(21), F.lit(24))
    named = [F.lit("all"), F.when(hour.between(8, 15), "flat"), F.when(off == 0, "rollover_ny"), F.when(off.isin(1, 23), "adjacent_ny"), F.when(hour == 21, "utc21_legacy")]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def weekend_gap(a: Column, b: Column) -> Column:
    """Whether the bars a and b (UTC) stand exactly at either end of a scheduled weekend."""
    la, lb = (F.from_utc_timestamp(x.cast("timestamp"), NEW_YORK).cast("timestamp_ntz") for x in (a, b))
    friday = (F.dayofweek(la) == 6) & (F.hour(la) == LAST_HOUR) & (F.minute(la) == 0)
    sunday = (F.dayofweek(lb) == 1) & (F.hour(lb) == REOPEN_HOUR) & (F.minute(lb) == 0)
    return friday & sunday & (F.datediff(lb, la) == 2)


def in_holiday_window(ts: Column) -> Column:
    m, d = F.month(ts), F.dayofmonth(ts)
    return ((m == 12) & (d >= 20)) | ((m == 1) & (d <= 3))


def gap_class(ts: Column, sharing: Column, total: Column) -> Column:
    """Class of an unscheduled gap that sharing of total instruments have."""
    return F.when(sharing < total, "PAIR_SPECIFIC").when(in_holiday_window(ts), "HOLIDAY_CANDIDATE").otherwise("FX_WIDE_UNSCHEDULED")


def add_months(d: datetime, n: int) -> datetime:
    """n months on, the day cut to the month's last."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = (datetime(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return d.replace(year=y, month=m + 1, day=min(d.day, last))


def calendar_years(start: datetime, end: datetime, most: int = 200) -> list[tuple[str, datetime, datetime]]:
    """(label, start, end) of each calendar year from start to end, both inclusive; a period ends a second before the next."""
    if end.year - start.year >= most:
        raise ValueError(f"more than {most} years")
    out = []
    for y in range(start.year, end.year + 1):
        out.append((str(y), max(start, datetime(y, 1, 1)), min(end, datetime(y + 1, 1, 1) - timedelta(seconds=1))))
    return out


def month_chunks(start: datetime, end: datetime, months: int, exclude: tuple[datetime, datetime] | None = None, least_days: int = 30) -> list[tuple[str, datetime, datetime]]:
    """Chunks of so many months from start; around an excluded window, chunks before and after it; those under least_days whole days go."""
    spans = [(start, end)] if exclude is None else [(start, exclude[0] - timedelta(seconds=1)), (exclude[1] + timedelta(seconds=1), end)]
    out = []
    for a, b in spans:
        while a < b:
            stop = min(add_months(a, months) - timedelta(seconds=1), b)
            if (stop - a).days >= least_days:
                out.append((f"{a:%Y-%m-%d}..{stop:%Y-%m-%d}", a, stop))
            a = stop + timedelta(seconds=1)
    return out


def quarter_end(year: int, quarter: int) -> datetime:
    return datetime(year + quarter // 4, quarter % 4 * 3 + 1, 1) - timedelta(seconds=1)


def year_periods(rows: DataFrame, by: Sequence[str], most: int = 200) -> DataFrame:
    """by, period, start, end: the calendar years of each series' coverage, both ends inclusive; a year ends a second before the next one. Of most years the first."""
    g = rows.groupBy(*by).agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    last = F.least(F.year("high"), F.year("low") + (most - 1))
    y = g.withColumn("y", F.explode(F.sequence(F.year("low"), last)))
    begin = lambda n: F.make_timestamp_ntz(n, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return y.select(*by, F.col("y").cast("string").alias("period"), F.greatest(begin(F.col("y")), F.col("low")).alias("start"), F.least(begin(F.col("y") + 1) - F.expr("INTERVAL 1 SECOND"), F.col("high")).alias("end"))


def quarter_label(ts: Column) -> Column:
    """24Q1 and the like."""
    return F.concat(F.date_format(ts, "yy"), F.lit("Q"), F.quarter(ts).cast("string"))


def quarter_last(ts: Column) -> Column:
    """The last second of the quarter that a stamp lies in."""
    return F.date_trunc("quarter", ts).cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), F.lit(3)) - F.expr("INTERVAL 1 SECOND")
