"""Timestamps and dates on columns. The day of asking is a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, normalize_whitespace, text

ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
# Month names by number.
MONTHS = {m[:k]: i + 1 for i, m in enumerate(("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")) for k in (3, len(m))} | {"sept": 9}
_EDGE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _iso(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def _epoch(number: Column) -> Column:
    ms = F.when(number > 1e15, number / 1000).when(number > 1e12, number).when(number > 1e9, number * 1000)
    return F.when(ms < 253402300800000.0, F.timestamp_millis(F.floor(ms).cast("long")))


def normalize_timestamp(x) -> Column:
    """Epoch seconds, milliseconds or microseconds, or something like ISO 8601, as ISO with milliseconds; else empty."""

    def read(y: Column) -> Column:
        number = F.when(y.rlike(r"^[0-9]{1,18}(\.[0-9]+)?\z"), y.try_cast("double"))
        found = F.regexp_extract(y, ISO, 0)
        return F.when(number.isNotNull(), _iso(_epoch(number))).when(found != "", _iso(F.try_to_timestamp(found))).otherwise(F.lit(""))

    return bind(F.trim(text(x)), read)


def plausible(x: Column, as_of_year: int, floor: int = 2020) -> Column:
    """Whether the year that the text begins with lies between floor and the year after."""
    return F.coalesce(F.regexp_extract(x, "^([0-9]{4})", 1).try_cast("int").between(floor, as_of_year + 1), F.lit(False))


def valid_timestamp(x, as_of_year: int) -> Column:
    return bind(normalize_timestamp(x), lambda y: F.when(plausible(y, as_of_year), y).otherwise(F.lit("")))


def read_time_candidate(x, as_of_year: int) -> Column:
    """Epochs as ISO; dates in other forms as they stand in the text."""
    return bind(normalize_whitespace(x), lambda y: _time_in(y, as_of_year))


def _time_in(y: Column, as_of_year: int) -> Column:
    ok = lambda t: F.when(F.regexp_extract(t, rf"{_EDGE}([0-9]{{4}}){_END}", 1).try_cast("int").between(2000, as_of_year + 1) | ~t.rlike(rf"{_EDGE}[0-9]{{4}}{_END}"), t).otherwise(F.lit(""))
    readable = rf"(?i){_EDGE}(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{{1,2}},?\s+[0-9]{{4}}(?:,?\s+[0-9]{{1,2}}:[0-9]{{2}}\s*(?:AM|PM)?)?"
    forms = [F.nullif(ok(F.regexp_extract(y, p, 0)), F.lit("")) for p in (ISO.replace("[T ]", r"[T\s]"), readable, r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日(?:\s*[0-9]{1,2}:[0-9]{2})?")]
    number = F.when(y.rlike(r"^[0-9]{1,18}(\.[0-9]+)?\z"), y.try_cast("double"))
    return F.when(number.isNotNull(), ok(_iso(_epoch(number)))).otherwise(F.coalesce(*forms, F.lit("")))


def date_from_parts(year: Column, month: Column, day: Column, as_of) -> Column:
    d = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when(d.isNotNull() & F.year(d).between(2000, as_of.year + 1), F.date_format(d, "yyyy-MM-dd")).otherwise(F.lit(""))


def _year_for(month: Column, day: Column, as_of) -> Column:
    """This year, or the last one if the day would be more than 36 hours ahead."""
    start = F.try_to_date(F.concat_ws("-", F.lit(str(as_of.year)), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when(F.datediff(start, F.lit(as_of)) > 1, as_of.year - 1).otherwise(as_of.year)


def history_date(x, as_of) -> Column:
    """struct(date, raw): the date that a history entry's text names, by the first form that it has, even if that is none in the calendar."""
    return bind(normalize_whitespace(x), lambda y: _date_in(y, as_of))


def _date_in(y: Column, as_of) -> Column:
    at = lambda p, k: F.regexp_extract(y, p, k)
    number = lambda p, k: at(p, k).try_cast("int")
    pair = lambda d, raw: F.struct(F.coalesce(d, F.lit("")).alias("date"), raw.alias("raw"))
    ago = lambda n, p: pair(F.date_format(F.date_sub(F.lit(as_of), n), "yyyy-MM-dd"), at(p, 0))
    today, yesterday = "(?i)今天|今日|today", "(?i)昨天|yesterday"
    dashed = rf"{_EDGE}(20[0-9]{{2}})[./-]([0-9]{{1,2}})[./-]([0-9]{{1,2}}){_END}"
    chinese = rf"{_EDGE}(20[0-9]{{2}})\s*年\s*([0-9]{{1,2}})\s*月\s*([0-9]{{1,2}})\s*日?"
    english = rf"{_EDGE}([A-Za-z]{{3,9}})\.?\s+([0-9]{{1,2}})(?:,\s*(20[0-9]{{2}}))?{_END}"
    month_day = rf"{_EDGE}([0-9]{{1,2}})\s*月\s*([0-9]{{1,2}})\s*日?"
    slashed = rf"{_EDGE}([0-9]{{1,2}})[./-]([0-9]{{1,2}})(?:[./-](20[0-9]{{2}}|[0-9]{{2}}))?{_END}"
    month = F.create_map(*(F.lit(v) for item in MONTHS.items() for v in item))[F.lower(at(english, 1))]
    short = F.when(F.length(at(slashed, 3)) == 2, F.concat(F.lit("20"), at(slashed, 3))).otherwise(at(slashed, 3)).try_cast("int")
    return (
        F.when(y == "", pair(F.lit(""), F.lit("")))
        .when(y.rlike(today), ago(0, today))
        .when(y.rlike(yesterday), ago(1, yesterday))
        .when(y.contains("前天"), ago(2, "前天"))
        .when(y.rlike(dashed), pair(date_from_parts(number(dashed, 1), number(dashed, 2), number(dashed, 3), as_of), at(dashed, 0)))
        .when(y.rlike(chinese), pair(date_from_parts(number(chinese, 1), number(chinese, 2), number(chinese, 3), as_of), at(chinese, 0)))
        .when(y.rlike(english) & month.isNotNull(), pair(date_from_parts(F.coalesce(number(english, 3), _year_for(month, number(english, 2), as_of)), month, number(english, 2), as_of), at(english, 0)))
        .when(y.rlike(month_day), pair(date_from_parts(_year_for(number(month_day, 1), number(month_day, 2), as_of), number(month_day, 1), number(month_day, 2), as_of), at(month_day, 0)))
        .when(y.rlike(slashed), pair(date_from_parts(F.coalesce(short, _year_for(number(slashed, 1), number(slashed, 2), as_of)), number(slashed, 1), number(slashed, 2), as_of), at(slashed, 0)))
        .otherwise(pair(F.lit(""), F.lit("")))
    )


def pair_timestamp(seconds: Column, nanos: Column) -> Column:
    """[seconds, nanoseconds] as ISO with milliseconds."""
    return _iso(F.timestamp_millis(F.round(seconds * 1000 + nanos / 1e6).cast("long")))
