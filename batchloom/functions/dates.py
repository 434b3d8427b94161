"""Date and time functions. Dates are DateType, datetimes TimestampType, times a number of seconds; weeks start on Sunday."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.missing import col

#: Months in an interval that consists of whole months.
MONTHS = {"MONTH": 1, "QTR": 3, "SEMIYEAR": 6, "YEAR": 12}


def _interval(name: str) -> tuple[str, int]:
    """Interval and multiple: MONTH3 is three months."""
    base = name.upper().rstrip("0123456789")
    return base, int(name[len(base) :] or 1)


def _month_number(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def _day_number(d: Column) -> Column:
    """Days since 1959-12-27, a Sunday."""
    return F.datediff(d, F.lit("1959-12-27").cast("date"))


def intck(interval: str, start, end) -> Column:
    """Interval boundaries crossed between two dates (or, for HOUR, MINUTE, SECOND and DT intervals, datetimes)."""
    base, k = _interval(interval)
    a, b = col(start), col(end)
    if base.startswith("DT"):
        base, a, b = base[2:], a.cast("date"), b.cast("date")
    if base in MONTHS:
        k *= MONTHS[base]
        return (F.floor(_month_number(b) / k) - F.floor(_month_number(a) / k)).cast("int")
    if base in ("DAY", "WEEK"):
        k *= 7 if base == "WEEK" else 1
        return (F.floor(_day_number(b) / k) - F.floor(_day_number(a) / k)).cast("int") if k > 1 else F.datediff(b, a)
    if base in ("HOUR", "MINUTE", "SECOND"):
        k *= {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}[base]
        return (F.floor(F.unix_seconds(b.cast("timestamp")) / k) - F.floor(F.unix_seconds(a.cast("timestamp")) / k)).cast("long")
    raise ValueError(f"unknown interval {interval}")


def intnx(interval: str, start, n, align: str = "B") -> Column:
    """A date moved by intervals: at the beginning (B), middle (M), end (E) or same place (S) of the interval."""
    base, k = _interval(interval)
    d, n, align = col(start).cast("date"), col(n).cast("int"), align.upper()[0]
    if base in MONTHS:
        k *= MONTHS[base]
        if align == "S":
            return F.add_months(d, n * k)
        first = F.add_months(F.trunc(d, "MM"), n * k - F.pmod(_month_number(d), F.lit(k)))
        last = F.date_sub(F.add_months(first, k), 1)
    elif base in ("DAY", "WEEK"):
        k *= 7 if base == "WEEK" else 1
        if align == "S":
            return F.date_add(d, n * k)
        first = F.date_add(F.date_sub(d, F.pmod(_day_number(d), F.lit(k)).cast("int")), n * k)
        last = F.date_add(first, k - 1)
    else:
        raise ValueError(f"unknown interval {interval}")
    return {"B": first, "E": last, "M": F.date_add(first, F.floor(F.datediff(last, first) / 2).cast("int"))}[align]


def datepart(ts) -> Column:
    return col(ts).cast("date")


def timepart(ts) -> Column:
    ts = col(ts)
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("double")


#: The moment that TODAY(), DATE(), DATETIME() and TIME() give; None is the session's clock.
RUN_AT: ContextVar[str | None] = ContextVar("run_at", default=None)


def today() -> Column:
    return datetime().cast("date")


def datetime() -> Column:
    return F.lit(RUN_AT.get()).cast("timestamp") if RUN_AT.get() else F.current_timestamp()


def time() -> Column:
    """Seconds of the day."""
    return timepart(datetime())


def mdy(m, d, y) -> Column:
    """Missing for an impossible date."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", col(y).cast("int"), col(m).cast("int"), col(d).cast("int")), "yyyy-MM-dd")


def ymd(y, m, d) -> Column:
    return mdy(m, d, y)


def year(d) -> Column:
    return F.year(col(d))


def qtr(d) -> Column:
    return F.quarter(col(d))


def month(d) -> Column:
    return F.month(col(d))


def day(d) -> Column:
    return F.dayofmonth(col(d))


def weekday(d) -> Column:
    return F.dayofweek(col(d))


def hour(t) -> Column:
    return F.hour(col(t))


def minute(t) -> Column:
    return F.minute(col(t))


def second(t) -> Column:
    return F.second(col(t))


def dhms(d, h, m, s) -> Column:
    """A datetime; hours, minutes and seconds may exceed their usual range."""
    seconds = col(h).cast("double") * 3600 + col(m).cast("double") * 60 + col(s).cast("double")
    return F.timestamp_micros(F.unix_micros(col(d).cast("timestamp")) + F.round(seconds * 1_000_000).cast("long"))


def hms(h, m, s) -> Column:
    return (col(h) * 3600 + col(m) * 60 + col(s)).cast("double")


def datdif(start, end, basis: str = "ACT/ACT") -> Column:
    """Days from start to end: actual ones (ACT/ACT, ACT/360, ACT/365), or of months of 30 days (30/360)."""
    a, b = col(start), col(end)
    basis = {"ACTUAL": "ACT/ACT", "360": "30/360"}.get(basis.upper(), basis.upper())
    if basis.startswith("ACT/"):
        return F.datediff(b, a)
    if basis != "30/360":
        raise ValueError(f"unknown basis {basis}")
    first = F.least(F.dayofmonth(a), F.lit(30))
    last = F.when((F.dayofmonth(b) == 31) & (first == 30), 30).otherwise(F.dayofmonth(b))
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + last - first
