"""Double-length Julian dates, ISO strings and UTC to TAI, as Columns. A date is a pair (high, low) of doubles.

Each step mentions its arguments several times: keep a step's pair as columns (with_pair) before the next step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First UTC day (Julian date) of each TAI - UTC offset in seconds since 1972, from the IERS leap second list.
LEAP_SECONDS = (
    (2441317.5, 10), (2441499.5, 11), (2441683.5, 12), (2442048.5, 13), (2442413.5, 14), (2442778.5, 15), (2443144.5, 16),
    (2443509.5, 17), (2443874.5, 18), (2444239.5, 19), (2444786.5, 20), (2445151.5, 21), (2445516.5, 22), (2446247.5, 23),
    (2447161.5, 24), (2447892.5, 25), (2448257.5, 26), (2448804.5, 27), (2449169.5, 28), (2449534.5, 29), (2450083.5, 30),
    (2450630.5, 31), (2451179.5, 32), (2453736.5, 33), (2454832.5, 34), (2456109.5, 35), (2457204.5, 36), (2457754.5, 37),
)


def two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """Knuth's error-free sum."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dl_add(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """The normalised double-length sum of two pairs."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def pair(jd: tuple[Column, Column]) -> Column:
    """A normalised pair as a struct (high, low), which orders as dates do: for lead(), least() and greatest()."""
    return F.struct(jd[0].alias("high"), jd[1].alias("low"))


def parts(struct: Column) -> tuple[Column, Column]:
    return struct["high"], struct["low"]


def iso_to_jd(text: Column) -> tuple[Column, Column]:
    """An ISO date and time of UTC, with up to nine digits of a second and with or without Z, as a normalised pair; null for null. Whatever the session's time zone is."""
    day = F.unix_date(F.to_date(F.substr(text, F.lit(1), F.lit(10))))
    clock = F.split(F.rtrim(F.substr(text, F.lit(12)), F.lit("Z")), "[:.]")
    number = lambda k: F.coalesce(F.nullif(F.get(clock, F.lit(k)), F.lit("")).cast("long"), F.lit(0).cast("long"))
    fraction = F.rpad(F.coalesce(F.get(clock, F.lit(3)), F.lit("0")), 9, "0").cast("long")
    nanos = ((number(0) * 60 + number(1)) * 60 + number(2)) * F.lit(10**9) + fraction
    return two_sum(day.cast("double") + F.lit(2440587.5), nanos.cast("double") / F.lit(86400e9))


def jd_to_iso(jd: tuple[Column, Column], digits: int = 3) -> Column:
    """The ISO time of a UTC pair, to `digits` (0 to 9) digits of a second, whatever the session's time zone is."""
    unit, per_day = 10**digits, 86400 * 10**digits
    whole = F.floor(jd[0] - F.lit(2440587.5))
    ticks = F.round(((jd[0] - F.lit(2440587.5) - whole) + jd[1]) * F.lit(float(per_day))).cast("long")
    day, rest = whole + F.floor(ticks / F.lit(per_day)), F.pmod(ticks, F.lit(per_day))
    part = lambda seconds, size: F.lpad(F.pmod(F.floor(rest / F.lit(unit * seconds)), F.lit(size)).cast("string"), 2, "0")
    clock = F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60))
    fraction = F.concat(F.lit("."), F.lpad(F.pmod(rest, F.lit(unit)).cast("string"), digits, "0")) if digits else F.lit("")
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T"), clock, fraction)


def _offset(day: Column, days: list[tuple[float, int]]) -> Column:
    table = F.array(*(F.struct(F.lit(first).alias("day"), F.lit(float(seconds)).alias("s")) for first, seconds in days))
    return F.aggregate(table, F.lit(None).cast("double"), lambda s, x: F.when(day >= x["day"], x["s"]).otherwise(s))


def utc_to_tai(jd: tuple[Column, Column]) -> tuple[Column, Column]:
    """TAI pair of a UTC pair from 1972 on; null before."""
    return dl_add(jd, (_offset(jd[0] + jd[1], LEAP_SECONDS) / F.lit(86400.0), F.lit(0.0)))


def with_tai(df: DataFrame, high: str, low: str, to_high: str, to_low: str) -> DataFrame:
    """Adds the TAI pair of the UTC pair in two columns; its offset is a column of its own, so that it is looked up once."""
    df = df.withColumn("_offset", _offset(F.col(high) + F.col(low), LEAP_SECONDS) / F.lit(86400.0))
    return with_pair(df, dl_add((F.col(high), F.col(low)), (F.col("_offset"), F.lit(0.0))), to_high, to_low).drop("_offset")


def tai_of(jd: float) -> tuple[float, float]:
    """The TAI pair of one UTC date from 1972 on."""
    if not jd >= LEAP_SECONDS[0][0]:
        raise ValueError(f"{jd} is before 1972")
    return dl_add((jd, 0.0), (max(s for day, s in LEAP_SECONDS if day <= jd) / 86400.0, 0.0))


def tai_to_utc(jd: tuple[Column, Column]) -> tuple[Column, Column]:
    """The inverse of utc_to_tai(); within a leap second, the second after it."""
    days = [(first + seconds / 86400.0, seconds) for first, seconds in LEAP_SECONDS]
    return dl_add(jd, (-_offset(jd[0] + jd[1], days) / F.lit(86400.0), F.lit(0.0)))


def with_pair(df: DataFrame, pair: tuple[Column, Column], high: str, low: str) -> DataFrame:
    return df.withColumns({high: pair[0], low: pair[1]})
