"""Date and calendar column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marketloom.functions.scalar import col

MON, THU, FRI = 2, 5, 6  # dayofweek numbers (Sunday = 1)


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday by the anonymous (Meeus/Jones/Butcher) algorithm, in integer arithmetic."""
    def div(x: Column, n: int) -> Column:
        return F.floor(x / n).cast("int")

    golden, century = year % 19, div(year, 100)
    leap_skip = century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3)
    epact = (19 * golden + leap_skip + 15) % 30
    in_century = year % 100
    weekday = (32 + 2 * (century % 4) + 2 * div(in_century, 4) - epact - in_century % 4) % 7
    fix = div(golden + 11 * epact + 22 * weekday, 451)
    n = epact + weekday - 7 * fix + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


def observed(day: Column) -> Column:
    """Saturday holidays are observed on Friday, Sunday holidays on Monday."""
    dow = F.dayofweek(day)
    return F.when(dow == 7, F.date_sub(day, 1)).when(dow == 1, F.date_add(day, 1)).otherwise(day)


def is_market_holiday(day: Column | str) -> Column:
    """Rule-based full-day US equity holidays."""
    d = col(day)
    y, m, dom, dow = F.year(d), F.month(d), F.dayofmonth(d), F.dayofweek(d)

    def fixed(year: Column, month: int, dom_: int) -> Column:
        return d == observed(F.make_date(year, F.lit(month), F.lit(dom_)))

    def nth(month: int, weekday: int, first: int, last: int) -> Column:
        return (m == month) & (dow == weekday) & dom.between(first, last)

    return (fixed(y, 1, 1) | fixed(y + 1, 1, 1) | fixed(y, 7, 4) | fixed(y, 12, 25)
            | ((y >= 2022) & fixed(y, 6, 19))
            | ((y >= 1998) & nth(1, MON, 15, 21)) | nth(2, MON, 15, 21)
            | (d == F.date_sub(easter(y), 2)) | nth(5, MON, 25, 31) | nth(9, MON, 1, 7) | nth(11, THU, 22, 28))


def is_trading_day(day: Column | str) -> Column:
    d = col(day)
    return ~F.dayofweek(d).isin(1, 7) & ~is_market_holiday(d)


def trading_calendar(bounds: DataFrame, first: str, last: str, pad_days: int = 15) -> DataFrame:
    """The day dimension between two dates of a one-row frame.

    Columns: day, is_session, session_no (sessions up to and including the day),
    previous_session, next_session.  It has one row per calendar day, so its
    unpartitioned window scans a few thousand rows at most per decade.
    """
    days = bounds.select(F.explode(F.sequence(F.date_sub(first, pad_days), F.date_add(last, pad_days))).alias("day"))
    c = days.withColumn("is_session", is_trading_day("day"))
    session = F.when(F.col("is_session"), F.col("day"))
    w = Window.orderBy("day")
    return c.withColumns({
        "session_no": F.sum(F.col("is_session").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "previous_session": F.last(session, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next_session": F.first(session, True).over(w.rowsBetween(1, Window.unboundedFollowing))})


def session_on_or_after(cal: DataFrame) -> DataFrame:
    """day -> the session a trade of that day belongs to (closed days roll forward)."""
    return cal.select("day", F.when(F.col("is_session"), F.col("day")).otherwise(F.col("next_session")).alias("session_date"))


def eastern_date(ts: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), "America/New_York"))


def latest_stable_session(instants: DataFrame, ts: str, cal: DataFrame, hour: int = 18, minute: int = 15) -> DataFrame:
    """The latest session whose data is final at an instant (after 18:15 Eastern of that day)."""
    local = F.from_utc_timestamp(F.col(ts), "America/New_York")
    d = instants.withColumns({"_day": F.to_date(local), "_late": F.hour(local) * 60 + F.minute(local) >= hour * 60 + minute})
    j = d.join(F.broadcast(cal.withColumnRenamed("day", "_day")), "_day", "left")
    return j.withColumn("stable_session", F.when(F.col("is_session") & F.col("_late"), F.col("_day")).otherwise(F.col("previous_session"))
                        ).drop("_day", "_late", "is_session", "session_no", "previous_session", "next_session")


def strict_date(text: Column | str) -> Column:
    """ISO yyyy-MM-dd text to a date; null unless it round-trips exactly."""
    t = col(text)
    d = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date"))
    return F.when(F.date_format(d, "yyyy-MM-dd") == t, d)


def compact_timestamp(text: Column | str) -> Column:
    """YYYYMMDDTHHMM[SS] text as a UTC timestamp."""
    t = col(text)
    return F.coalesce(F.when(F.length(t) == 15, F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss"))),
                      F.when(F.length(t) == 13, F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmm"))))


def period_class(start: Column | str, end: Column | str) -> Column:
    """instant / quarter / ytd / annual / other by the number of days covered."""
    s, days = col(start), F.datediff(col(end), col(start))
    return (F.when(s.isNull(), "instant").when(days >= 300, "annual").when(days.between(70, 120), "quarter")
            .when((days > 120) & (days < 300), "ytd").otherwise("other"))


def disclosure_day(filed: Column | str, accepted: Column | str) -> Column:
    """Later of the filing date and the Eastern acceptance date; zone-less stamps count one extra day.

    ``accepted`` is the raw text, so a missing zone can be told apart.
    """
    f, a = col(filed).cast("date"), col(accepted)
    zoned = a.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    day = F.when(zoned, eastern_date(F.try_to_timestamp(a))).otherwise(F.date_add(F.try_to_timestamp(a).cast("date"), 1))
    return F.greatest(f, day)


def month_bounds(day: Column | str) -> tuple[Column, Column]:
    return F.trunc(col(day), "month"), F.last_day(col(day))


def years_before(day: Column | str, years: int) -> Column:
    return F.add_months(col(day), -12 * years)
