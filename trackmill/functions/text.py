"""Readable texts of numbers and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long").cast("string")


def _fixed(x: Column, digits: int) -> Column:
    """Rounded by the exact value of the double, halves to even, as C and DuckDB print; Java's formatter rounds the shortest decimals, halves up."""
    x, scale = x.cast("double"), float(10**digits)
    scaled, high = x * scale, x.cast("float").cast("double")
    # What the product lost: of a float and of the rest it is exact. It decides where the product stands on a half.
    lost = (high * scale - scaled) + (x - high) * scale
    half = scaled - F.floor(scaled) == 0.5
    whole = F.when(half & (lost > 0), F.ceil(scaled).cast("double")).when(half & (lost < 0), F.floor(scaled).cast("double")).otherwise(F.rint(scaled))
    return F.format_string(f"%.{digits}f", whole / scale)


def seconds(total: Column) -> Column:
    """`1h 2m 3s`; zero parts are left out. The seconds are rounded, halves up, so they can read 60."""
    hours, minutes, rest = total / 3600, F.pmod(total.cast("double"), F.lit(3600.0)) / 60, F.pmod(total.cast("double"), F.lit(60.0))
    parts = (F.when(F.floor(hours) > 0, F.concat(_whole(hours), F.lit("h"))), F.when(F.floor(minutes) > 0, F.concat(_whole(minutes), F.lit("m"))), F.when(rest >= 0.5, F.concat(_whole(rest + 0.5), F.lit("s"))))
    return F.concat_ws(" ", *parts)


def time_diff(start: Column, end: Column) -> Column:
    """The two largest units between two epoch seconds, such as `2d 3h` or `4m 5s`."""
    ms = F.floor((end - start) * 1000)
    day, hour, minute = 86_400_000, 3_600_000, 60_000
    days, hours, minutes, secs = F.floor(ms / day), F.floor(F.pmod(ms, F.lit(day)) / hour), F.floor(F.pmod(ms, F.lit(hour)) / minute), F.floor(F.pmod(ms, F.lit(minute)) / 1000)
    return F.when(days > 0, F.format_string("%dd %dh", days, hours)).when(hours > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(F.format_string("%dm %ds", minutes, secs))


def minutes(x: Column) -> Column:
    """`m:ss` of a number of minutes."""
    return F.concat(_whole(x), F.lit(":"), F.lpad(_whole((x - F.floor(x)) * 60), 2, "0"))


def pace_no_unit(kmh: Column) -> Column:
    """Minutes for a kilometre; null at a standstill."""
    return minutes(F.try_divide(F.lit(60.0), kmh))


def pace(kmh: Column) -> Column:
    return F.concat(pace_no_unit(kmh), F.lit(" min/km"))


def speed(kmh: Column) -> Column:
    return F.concat(_fixed(kmh, 2), F.lit(" kph"))


def heart_rate(bpm: Column) -> Column:
    return F.when(bpm.isNull() | (bpm == 0), "unknown bpm").otherwise(F.concat(_fixed(bpm, 0), F.lit(" bpm")))


def distance(metres: Column) -> Column:
    return F.when(metres < 1000, F.concat(_fixed(metres, 0), F.lit(" m"))).otherwise(F.concat(_fixed(metres / 1000, 2), F.lit(" km")))


def whole_or_unknown(x: Column) -> Column:
    return F.when(x.isNull() | (x == 0), "?").otherwise(_fixed(x, 0))


def wind(average: Column, gust: Column, direction: Column) -> Column:
    """`12g15 knots @40°`; a direction of 0 is left out, an average or gust of 0 is unknown."""
    missing = lambda x: x.isNull() | (x == 0)
    at = F.when(missing(direction), "").otherwise(F.concat(F.lit(" @"), direction.cast("long").cast("string"), F.lit("°")))
    return F.when(missing(average) | missing(gust), "unknown").otherwise(F.concat(_fixed(average, 0), F.lit("g"), _fixed(gust, 0), F.lit(" knots"), at))


def comma(x: Column) -> Column:
    """Whole number with thousands separated."""
    return F.format_number(x, 0)


def date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def time(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def month_year(ts: Column) -> Column:
    return F.date_format(ts, "MMM yyyy")


def foil_name(foil: Column) -> Column:
    """The name without its first area such as ` 725.0 cm2`; null or empty is an unknown foil."""
    named = F.when(foil.isNull() | (foil == ""), "unknown foil").otherwise(foil)
    return F.regexp_replace(named, r"(?s)^(.*?)\s+\d+\.\d+ cm2", "$1")


def run_key(path: Column) -> Column:
    """File name without folders and without its first `.csv`."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(path, "%20", " "), "/", -1), r"(?s)^(.*?)\.csv", "$1")


def unit_name(code: Column) -> Column:
    """Name of a buoy unit code, null if unknown."""
    # The unit codes of buoy files.
    names = {"yr": "year", "mo": "month", "dy": "day", "hr": "hour", "mn": "minute", "degT": "degrees", "m/s": "meters_per_sec", "m": "meters", "sec": "seconds",
             "hPa": "hecto_pascal", "degC": "degrees", "nmi": "nautical_miles", "mi": "miles", "ft": "feet", "deg": "degrees"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code)
