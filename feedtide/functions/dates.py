"""Feed, sitemap and capture dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Zone names of RFC 822 mail dates and their offsets.
ZONE_OFFSETS = {
    "UT": "+0000",
    "UTC": "+0000",
    "GMT": "+0000",
    "Z": "+0000",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}

_MAIL_DATE = (
    r"^([A-Za-z]+\s*,?\s*)?\d{1,2}\s+[A-Za-z]{3,}\s+(\d{4}|\d{2})"
    r"(\s+\d{1,2}:\d{2}(:\d{2})?\s*([+-]\d{4}|[A-Za-z]+)?)?$"
)
_ISO_DATE = r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?)?)?$"

# rewriting steps that bring a mail date to "d MMM yyyy H:mm:ss <zone>"
_MAIL_STEPS = (
    (r"^[A-Za-z]+\s*,?\s*", ""),
    (r"^(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+", "$1 $2 "),
    (r"^(\S+ \S+) ([0-6]\d)(?=\s|$)", "$1 20$2"),
    (r"^(\S+ \S+) ([7-9]\d)(?=\s|$)", "$1 19$2"),
    (r"^(\S+ \S+ \d{4})$", "$1 0:00:00"),
    (r"^(\S+ \S+ \d{4})\s+(\d{1,2}:\d{2})(?![:\d])", "$1 $2:00"),
    (r"^(\S+ \S+ \d{4})\s+(\d{1,2}:\d{2}:\d{2})\s*", "$1 $2 "),
)


def _mail_date(text: Column) -> Column:
    steady = text
    for pattern, replacement in _MAIL_STEPS:
        steady = F.regexp_replace(steady, pattern, replacement)
    offsets = F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair])
    zone = F.substring_index(steady, " ", -1)
    numeric = F.when(zone.rlike(r"^[+-]\d{4}$"), zone)
    offset = F.coalesce(numeric, F.try_element_at(offsets, F.upper(zone)), F.lit("+0000"))
    clock = F.concat(F.initcap(F.substring_index(steady, " ", 4)), F.lit(" "), offset)
    return F.when(text.rlike(_MAIL_DATE), F.try_to_timestamp(clock, F.lit("d MMM yyyy H:mm:ss Z")))


def feed_date(raw: Column) -> Column:
    """RFC 822 or ISO 8601 date as TIMESTAMP; NULL if it is neither. No zone means UTC."""
    text = F.regexp_replace(F.regexp_replace(raw, r"^\s+", ""), r"\s+$", "")
    clock = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(?=$|[ Z+-])", "$1:00")
    clock = F.regexp_replace(clock, r"(:\d{2}[.\d]*\s*[+-]\d{2})(\d{2})$", "$1:$2")
    iso = clock.try_cast("timestamp")
    return F.when(text.rlike(_ISO_DATE), iso).otherwise(_mail_date(text))


def feed_date_text(raw: Column) -> Column:
    """`feed_date` rendered as yyyy-MM-ddTHH:mm:ssZ (session time zone UTC)."""
    return F.date_format(feed_date(raw), ISO_SECONDS)


def stamp_to_timestamp(stamp: Column) -> Column:
    """14-digit capture stamp (yyyyMMddHHmmss) as TIMESTAMP; NULL if unparseable."""
    return F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))


def display_date(stamp: Column) -> Column:
    return F.date_format(stamp_to_timestamp(stamp), "dd/MM/yyyy")
