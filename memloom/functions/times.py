"""Raw times to instants, in JVM expressions only.

An ordered cascade of anchored patterns is tried on the trimmed text; the first
pattern that matches decides, and its parts must form a real date and time,
otherwise the time is unusable and the result is null.  Nothing is guessed from
the session: the result is microseconds since 1970-01-01 UTC as a bigint.

Policy
* no zone in the text: the row's zone holds; a null, blank or unknown zone name is UTC;
* a wall time that occurs twice is the earlier instant;
* a wall time that is skipped is read with the offset before the change;
* digits beyond microseconds are cut off; missing parts are zero;
* bare digits of 10, 13 or 16 places are seconds, milliseconds or microseconds,
  and must fall into the years 2020 to 2029;
* zone abbreviations have their American or European meaning.

Null, blank and unreadable texts give null.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offsets in minutes of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "WET": 0, "WEST": 60, "BST": 60, "IST": 60,
    "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
    "JST": 540, "AEST": 600, "AEDT": 660,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: Bare numbers must lie in [2020-01-01, 2030-01-01).
EPOCH_FROM, EPOCH_TO = 1_577_836_800, 1_893_456_000

_FRACTION = r"(?:[.,](?<f>\d{1,12}))?"
_ZONE = r"(?:\s*(?<z>[A-Za-z]{1,5}|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|(?:UTC|GMT)?[+-]\d{2}))?"
_CLOCK = rf"(?<h>\d{{1,2}}):(?<i>\d{{2}})(?::(?<s>\d{{2}}){_FRACTION})?"
_WEEKDAY = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*"
_NAME = r"(?<n>[A-Za-z]{3,9})\.?"

#: (name, pattern) in the order in which they are tried; the groups are y, m or n, d, h, i, s, f, p, z.
FORMATS: list[tuple[str, str]] = [
    ("iso", rf"^(?<y>\d{{4}})-(?<m>\d{{2}})-(?<d>\d{{2}})(?:[Tt ]\s*{_CLOCK}{_ZONE})?$"),
    ("basic", rf"^(?<y>\d{{4}})(?<m>\d{{2}})(?<d>\d{{2}})[Tt](?<h>\d{{2}})(?<i>\d{{2}})(?:(?<s>\d{{2}}){_FRACTION})?{_ZONE}$"),
    ("slash_year", rf"^(?<y>\d{{4}})/(?<m>\d{{1,2}})/(?<d>\d{{1,2}})(?:\s+\({_WEEKDAY}\))?(?:\s+{_CLOCK}{_ZONE})?$"),
    ("slash_us", rf"^(?<m>\d{{1,2}})/(?<d>\d{{1,2}})/(?<y>\d{{4}})(?:,?\s+{_CLOCK}(?:\s*(?<p>[AaPp][Mm]))?{_ZONE})?$"),
    ("dotted", rf"^(?<d>\d{{1,2}})\.(?<m>\d{{1,2}})\.(?<y>\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$"),
    ("day_first", rf"^(?:{_WEEKDAY},?\s+)?(?<d>\d{{1,2}})\s+{_NAME}\s+(?<y>\d{{4}})(?:,?\s+{_CLOCK}(?:\s*(?<p>[AaPp][Mm]))?{_ZONE})?$"),
    ("month_first", rf"^(?:{_WEEKDAY},?\s+)?{_NAME}\s+(?<d>\d{{1,2}}),?\s+(?<y>\d{{4}})(?:,?\s+{_CLOCK}(?:\s*(?<p>[AaPp][Mm]))?{_ZONE})?$"),
]


PARTS = "ymdhisfpz"


def _canonical(text: Column) -> Column:
    """The parts of the first format that matches, as ``y|m|d|h|i|s|f|p|z``; null if none does."""
    found = None
    for _, pattern in FORMATS:
        named = [k for k in PARTS if f"(?<{k}>" in pattern]
        month = "n" if "(?<n>" in pattern else "m"
        form = "|".join(f"${{{month if k == 'm' else k}}}" if k in named or (k == "m" and month == "n") else "" for k in PARTS)
        condition, value = text.rlike(pattern), F.regexp_replace(text, pattern, form)
        found = F.when(condition, value) if found is None else found.when(condition, value)
    return found


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC for an offset or an abbreviation, else null."""
    number = F.regexp_extract(zone, r"([+-]\d{2}:?\d{0,2})$", 1)
    sign = F.when(F.substring(number, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    minutes = F.regexp_extract(number, r"^[+-]\d{2}:?(\d{2})$", 1)
    hours = F.substring(number, 2, 2).try_cast("int")
    m = F.coalesce(minutes.try_cast("int"), F.lit(0))
    named = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.when(number != "", F.when((hours <= 18) & (m < 60), sign * (hours * 60 + m))).otherwise(F.try_element_at(named, F.upper(zone)))


def _wall_micros(y: Column, m: Column, d: Column, h: Column, i: Column, s: Column, micros: Column) -> Column:
    """Microseconds of a wall time as if it were UTC; null unless date and time exist."""
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    day = F.unix_date(F.try_to_date(text, "yyyy-MM-dd"))
    ok = (h <= 23) & (i <= 59) & (s <= 59) & m.between(1, 12) & d.between(1, 31) & y.between(1, 9999)
    return F.when(ok, day.cast("bigint") * F.lit(86_400_000_000) + (h * 3600 + i * 60 + s).cast("bigint") * F.lit(1_000_000) + micros)


def _of_zone(wall: Column, zone: Column) -> Column:
    """The instant of a wall time in a named zone (earlier of two, offset before a gap)."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def zone_or_utc(zone: Column) -> Column:
    """``zone`` if it is a known zone name, else UTC."""
    name = F.trim(zone)
    return F.when(name.isin(sorted(available_timezones())), name).otherwise(F.lit("UTC"))


def with_utc_micros(df: DataFrame, raw: str, zone: str | None, out: str) -> DataFrame:
    """``df`` with the bigint column ``out``: microseconds since 1970 UTC of the raw time ``raw``.

    ``zone`` names the column of the row's zone.  The work is done in steps that
    each read the step before by name, so that every pattern is tried once a row.
    """
    num = lambda k: F.get(F.col("_t_parts"), PARTS.index(k)).try_cast("int")
    txt = lambda k: F.get(F.col("_t_parts"), PARTS.index(k))
    full = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "sept"]
    name = F.lower(txt("m"))
    month_of_name = F.when(
        (F.length(name) == 3) | name.isin(full), F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.substring(name, 1, 3)).cast("int")
    )
    half, hour = F.lower(txt("p")), F.coalesce(num("h"), F.lit(0))
    size, number = F.length("_t_text"), F.col("_t_text").try_cast("bigint")
    step = (
        df.withColumn("_t_text", F.regexp_replace(F.col(raw), r"^\s+|\s+$", ""))
        .withColumn("_t_zone", zone_or_utc(F.col(zone)) if zone else F.lit("UTC"))
        .withColumn("_t_digits", F.col("_t_text").rlike(r"^(?:\d{10}|\d{13}|\d{16})$"))
        .withColumn("_t_parts", F.split(F.when(~F.col("_t_digits"), _canonical(F.col("_t_text"))), r"\|", -1))
        .withColumn(
            "_t_hour",
            F.when(half == "", hour).when(~hour.between(1, 12), F.lit(99)).otherwise(hour % 12 + F.when(half == "pm", F.lit(12)).otherwise(F.lit(0))),
        )
        .withColumn("_t_month", F.coalesce(num("m"), month_of_name, F.lit(0)))
        .withColumn("_t_micros", F.coalesce(F.rpad(F.substring(txt("f"), 1, 6), 6, "0").try_cast("bigint"), F.lit(0)))
        .withColumn(
            "_t_wall",
            _wall_micros(
                num("y"), F.col("_t_month"), num("d"), F.col("_t_hour"), F.coalesce(num("i"), F.lit(0)), F.coalesce(num("s"), F.lit(0)), F.col("_t_micros")
            ),
        )
        .withColumn(
            "_t_number",
            F.when(F.col("_t_digits"), F.when(size == 10, number * 1_000_000).when(size == 13, number * 1_000).otherwise(number)),
        )
        .withColumn("_t_offset", _offset_minutes(txt("z")))
    )
    from_number = F.when(F.col("_t_number").between(EPOCH_FROM * 1_000_000, EPOCH_TO * 1_000_000 - 1), F.col("_t_number"))
    from_text = F.when(txt("z") == "", _of_zone(F.col("_t_wall"), F.col("_t_zone"))).otherwise(
        F.col("_t_wall") - F.col("_t_offset").cast("bigint") * 60_000_000
    )
    value = F.when(F.col("_t_digits"), from_number).otherwise(from_text)
    # The one-row generator keeps a filter on the result from being pushed through
    # every step, which would write all of the patterns out several times over.
    return step.withColumn(out, F.explode(F.array(value))).drop(*[c for c in step.columns if c.startswith("_t_")])
