"""Times and durations as text, and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """Seconds as h:mm:ss, or m:ss under an hour; null, negative and not-a-number are 0:00."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    out = F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))
    return F.when(seconds.isNull() | (seconds < 0) | F.isnan(seconds.cast("double")), "0:00").otherwise(out)


def uptime(seconds: Column) -> Column:
    """Seconds as "Xd, Yh, Zm"; parts that are 0 are left out, except minutes alone."""
    d, h, m = F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60)
    part = lambda x, unit: F.when(x > 0, F.concat(x.cast("string"), F.lit(unit)))
    return F.concat_ws(", ", part(d, "d"), part(h, "h"), F.when((m > 0) | ((d == 0) & (h == 0)), F.concat(m.cast("string"), F.lit("m"))))


def relative(ts: Column, now: Column) -> Column:
    """Now under a minute, Nm, Nh on the same day, Yesterday, else month and day. `now` is given, so results repeat."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 60)
    days = F.datediff(F.to_date(now), F.to_date(ts))
    return (
        F.when(minutes < 1, "Now").when((days == 0) & (minutes < 60), F.concat(minutes.cast("string"), F.lit("m")))
        .when(days == 0, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"))).when(days == 1, "Yesterday").otherwise(F.date_format(ts, "MMMM dd"))
    )


def stopwatch(ticks: Column) -> Column:
    """Ticks of 10 ms as MM:SS.cc."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(ticks / 6000)), F.lit(":"), two(F.floor(ticks % 6000 / 100)), F.lit("."), two(ticks % 100))


def minutes_of_day(hh_mm: Column) -> Column:
    return F.split(hh_mm, ":")[0].cast("int") * 60 + F.split(hh_mm, ":")[1].cast("int")


def in_day_range(at: Column, start: Column, end: Column) -> Column:
    """Whether a minute of the day lies in a range with both ends, which may pass midnight."""
    return F.when(start < end, at.between(start, end)).otherwise((at >= start) | (at <= end))


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "EEEE, dd MMMM yyyy")


def is_leap(year: Column) -> Column:
    return (year % 400 == 0) | ((year % 4 == 0) & (year % 100 != 0))


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def first_of_month(day: Column, months: int | Column = 0) -> Column:
    """First day of the month so many months on."""
    return F.add_months(F.trunc(day, "MM"), months)


def calendar_grid(months: DataFrame, month: str = "month") -> DataFrame:
    """Six weeks of seven days from the Monday on or before the first, with -1, 0, 1 for the month before, itself, after.

    One row for each month, week (0-5) and weekday (0 Monday - 6): day, date, place.
    """
    first = F.trunc(F.col(month), "MM")
    monday = F.date_sub(first, (F.dayofweek(first) + 5) % 7)
    cells = months.select(month, F.posexplode(F.sequence(monday, F.date_add(monday, 41))).alias("at", "date"))
    place = F.when(F.col("date") < F.trunc(F.col(month), "MM"), -1).when(F.col("date") > F.last_day(month), 1).otherwise(0)
    return cells.select(month, F.expr("cast(at div 7 as int)").alias("week"), (F.col("at") % 7).alias("weekday"), F.dayofmonth("date").alias("day"), "date", place.alias("place"))


def cycle_phase(elapsed: Column, focus: int, rest: int, long_rest: int, cycles: int) -> Column:
    """Phase of a timer of focus periods, each followed by a rest, the last of a round by a long rest: phase, cycle (from 0), seconds left."""
    round_ = cycles * focus + (cycles - 1) * rest + long_rest
    at = F.pmod(elapsed, F.lit(round_))
    cycle = F.least(F.floor(at / (focus + rest)), F.lit(cycles - 1)).cast("int")
    inside = at - cycle * (focus + rest)
    pause = F.when(cycle == cycles - 1, long_rest).otherwise(rest)
    return F.struct(F.when(inside < focus, "focus").when(cycle == cycles - 1, "long rest").otherwise("rest").alias("phase"), cycle.alias("cycle"), F.when(inside < focus, focus - inside).otherwise(focus + pause - inside).alias("left"))
