"""Time columns. Four clocks are kept apart: seen, stated (by the outlet), retrieved, checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLIEST = "1995-01-01 00:00:00"

_ISO = (
    r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(?:[.,](\d{1,6})\d*)?"
    r"(Z|[+-]\d{2}(?::?\d{2}(?::\d{2})?)?)$"
)
_RFC = (
    r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})[ -]+([a-z]{3})[a-z]*[ -]+(\d{4}|\d{2}),?\s+(\d{1,2}:\d{2})(:\d{2})?\s+"
    r"([+-]\d{4}|ut|utc|gmt|z|est|edt|cst|cdt|mst|mdt|pst|pdt)(?:\s*\(.*\))?$"
)
# Zone names of the mail date format, as offsets.
MAIL_ZONES = {
    "ut": "+00:00", "utc": "+00:00", "gmt": "+00:00", "z": "+00:00", "est": "-05:00", "edt": "-04:00",
    "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00",
}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _at(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("timestamp")


def parse_zoned_ts(c: Column) -> Column:
    """ISO 8601 date and time with a zone, else null. Zone-less text never reaches the timestamp parser, which
    would read it in the session zone."""
    text = F.trim(c)
    part = lambda i: F.regexp_extract(text, _ISO, i)
    seconds = F.when(part(3) == "", ":00").otherwise(part(3))
    fraction = F.when(part(4) == "", "").otherwise(F.concat(F.lit("."), part(4)))
    digits = F.regexp_replace(F.regexp_replace(part(5), "Z", "+0000"), ":", "")
    zone = F.concat(
        F.left(digits, F.lit(3)), F.lit(":"),
        F.when(F.length(digits) >= 5, F.substr(digits, F.lit(4), F.lit(2))).otherwise("00"),
    )
    return F.when(text.rlike(_ISO), _at(F.concat(part(1), F.lit("T"), part(2), seconds, fraction, zone)))


def parse_mail_ts(c: Column) -> Column:
    """RFC 822 date with a zone, else null. Rebuilt as ISO text first: the weekday pattern raises on bad input."""
    text = F.trim(c)
    part = lambda i: F.regexp_extract(text, _RFC, i)
    months = F.create_map(*[F.lit(v) for i, m in enumerate(_MONTHS) for v in (m, f"{i + 1:02d}")])
    zones = F.create_map(*[F.lit(v) for pair in MAIL_ZONES.items() for v in pair])
    raw = F.lower(part(6))
    zone = F.when(raw.rlike(r"^[+-]"), F.concat(F.left(raw, F.lit(3)), F.lit(":"), F.right(raw, F.lit(2))))
    zone = F.coalesce(zone, F.try_element_at(zones, raw))
    month = F.try_element_at(months, F.lower(part(2)))
    seconds = F.when(part(5) == "", ":00").otherwise(part(5))
    clock = F.lpad(part(4), 5, "0")
    day = F.lpad(part(1), 2, "0")
    # two digits: 69 and later are of the last century, as mail readers take them
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(F.concat(F.when(part(3) >= "69", "19").otherwise("20"), part(3)))
    iso = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit("T"), clock, seconds, zone)
    return F.when(text.rlike(_RFC), _at(iso))


def parse_feed_ts(c: Column) -> Column:
    return F.coalesce(parse_zoned_ts(c), parse_mail_ts(c))


def parse_compact_ts(c: Column, pattern: str) -> Column:
    """`yyyyMMddHHmmss` and `yyyyMMdd'T'HHmmss'Z'` stamps; digits are checked before parsing."""
    shape = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$" if pattern == "slot" else r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$"
    p = lambda i: F.regexp_extract(c, shape, i)
    iso = F.concat(p(1), F.lit("-"), p(2), F.lit("-"), p(3), F.lit("T"), p(4), F.lit(":"), p(5), F.lit(":"), p(6), F.lit("Z"))
    return F.when(c.rlike(shape), _at(iso))


_GRAPH_TIME = r"^([+-])(\d{1,16})-(\d{2})-(\d{2})T"


def partial_date_text(time: Column, precision: Column) -> Column:
    """A statement's date at the precision it is stated; null before our era or past the year 9999."""
    part = lambda i: F.regexp_extract(time, _GRAPH_TIME, i)
    year = F.try_to_number(part(2), F.lit("9999999999999999")).cast("bigint")
    text = F.lpad(year.cast("string"), 4, "0")
    shown = (
        F.when(precision >= 11, F.concat_ws("-", text, part(3), part(4)))
        .when(precision == 10, F.concat_ws("-", text, part(3)))
        .otherwise(text)
    )
    return F.when(partial_date(time, precision).isNotNull(), shown)


def partial_date(time: Column, precision: Column) -> Column:
    """The same date to compare with: a month or day given as 00 counts as the first."""
    part = lambda i: F.regexp_extract(time, _GRAPH_TIME, i)
    year = F.try_to_number(part(2), F.lit("9999999999999999")).cast("bigint")
    good = time.rlike(_GRAPH_TIME) & (part(1) == "+") & (year <= 9999) & (year >= 1) & precision.isNotNull()
    first = lambda p: F.when(p == "00", "01").otherwise(p)
    iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), first(part(3)), first(part(4)))
    return F.when(good, F.try_to_timestamp(F.concat(iso, F.lit("T00:00:00Z"))))


def shown_at(stated: Column, seen: Column) -> Column:
    """The date shown, sorted and filtered by: the outlet's own when known, else when first seen."""
    return F.coalesce(stated, seen)


def date_kind(stated: Column) -> Column:
    return F.when(stated.isNotNull(), "published").otherwise("seen")


def local_day(c: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(c, zone))


def utc_hour(c: Column) -> Column:
    return F.date_trunc("hour", c)


def seconds_between(a: Column, b: Column) -> Column:
    """a - b in seconds, with the fraction."""
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1_000_000)
