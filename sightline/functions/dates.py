"""Date expressions. Every "now" is a parameter, never the clock of a machine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions import constants as K
from sightline.functions.text import _MONTH_ALT, let, literals, mentions, normalize_text

_YEAR = r"(?:19|20)\d{2}"
_ANY_DATE = (
    rf"({_YEAR}-\d{{2}}-\d{{2}}(?:t[\d:.+z-]*)?"
    rf"|(?<![A-Za-z0-9_])\d{{1,2}}(?:er)?\s+(?:{_MONTH_ALT})\.?\s+{_YEAR}"
    rf"|(?<![A-Za-z0-9_])(?:{_MONTH_ALT})\.?\s+\d{{1,2}},?\s+{_YEAR}"
    rf"|(?<![A-Za-z0-9_])\d{{1,2}}[/.]\d{{1,2}}[/.]{_YEAR})"
)
_SECONDS_PER_MONTH = K.DAYS_PER_MONTH * 86400


def _month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.MONTHS.items() for x in pair])
    return F.try_element_at(table, name)


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def parse_written_date(raw: Column, lang: Column | str = "fr") -> Column:
    """ISO, ``12 mars 2026``, ``March 12, 2026`` or ``12/03/2026`` -> YYYY-MM-DD, else null."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    iso = rf"^{_YEAR}-\d{{2}}-\d{{2}}"
    day_first = rf"^(\d{{1,2}})(?:er)?\s+({_MONTH_ALT})\.?\s+({_YEAR})"
    month_first = rf"^({_MONTH_ALT})\.?\s+(\d{{1,2}}),?\s+({_YEAR})"
    numeric = rf"^(\d{{1,2}})[/.](\d{{1,2}})[/.]({_YEAR})"

    def day_text(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, _two(month), _two(day))

    def from_numbers(p: Column) -> Column:
        first_is_day = (lang != "en") | (p["a"] > 12)
        day = F.when(first_is_day, p["a"]).otherwise(p["b"])
        month = F.when(first_is_day, p["b"]).otherwise(p["a"])
        return F.when(month.between(1, 12) & day.between(1, 31), day_text(p["year"], month, day))

    def read(s: Column) -> Column:
        def part(pattern: str, group: int) -> Column:
            return F.regexp_extract(s, pattern, group)

        numbers = F.struct(
            part(numeric, 1).try_cast("int").alias("a"), part(numeric, 2).try_cast("int").alias("b"), part(numeric, 3).alias("year")
        )
        return (
            F.when(s.rlike(iso), part(iso, 0))
            .when(s.rlike(day_first), day_text(part(day_first, 3), _month_number(part(day_first, 2)), part(day_first, 1).try_cast("int")))
            .when(s.rlike(month_first), day_text(part(month_first, 3), _month_number(part(month_first, 1)), part(month_first, 2).try_cast("int")))
            .when(s.rlike(numeric), let(numbers, from_numbers))
        )

    return let(F.trim(normalize_text(raw)), read)


def date_after_marker(normalized: Column, markers: str, lang: Column | str = "fr") -> Column:
    """First date that directly follows one of the markers in a normalised text."""
    found = F.regexp_extract(normalized, rf"(?i)(?:{markers})\s*(?:le|on|:|-)?\s*{_ANY_DATE}", 1)
    # A text without a marker, or without a year, has no such date and is not searched.
    searched = F.when(mentions(normalized, ["19", "20"]) & mentions(normalized, literals(markers)) & normalized.rlike(_YEAR), found)
    return let(searched, lambda f: F.when(f != "", parse_written_date(f, lang)))


def local_day(ts_utc: Column, time_zone: str = K.DEFAULT_TIME_ZONE) -> Column:
    """Calendar day of a UTC timestamp (without zone) in a named time zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(time_zone), ts_utc.cast("timestamp_ntz")), "yyyy-MM-dd")


def to_instant(value: Column) -> Column:
    """ISO text to a UTC timestamp without zone, null when it is not a date."""
    shifted = F.regexp_extract(value, r"(?:Z|[+-]\d{2}:?\d{2})$", 0)
    zone = F.when((shifted == "") | (shifted == "Z"), F.lit("+00:00")).otherwise(
        F.regexp_replace(shifted, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    )
    stamp = F.regexp_replace(F.regexp_replace(value, r"(?:Z|(?<=:\d{2})[+-]\d{2}:?\d{2}|(?<=\.\d{1,6})[+-]\d{2}:?\d{2})$", ""), "T", " ")
    local = F.when(stamp.rlike(r"^\d{4}-\d{2}"), stamp.try_cast("timestamp_ntz"))
    has_time = stamp.rlike(r"\d{2}:\d{2}")
    return F.when(has_time, F.convert_timezone(zone, F.lit("UTC"), local)).otherwise(local)


def months_since(moment: Column, now: Column) -> Column:
    """Months of 30.4375 days between two timestamps without zone."""
    micros = F.timestamp_diff("MICROSECOND", moment, now)
    return micros / F.lit(_SECONDS_PER_MONTH * 1e6)


def age_in_months(modified: Column, published: Column, now: Column) -> Column:
    """Age of the latest date (never in the future), one decimal; 60 without any date."""
    latest = F.greatest(to_instant(modified), to_instant(published))
    age = F.floor(months_since(F.least(latest, now), now) * 10 + 0.5) / 10
    return F.when(latest.isNotNull(), age).otherwise(60.0)


def effective_date(modified: Column, published: Column, title_year: Column, now: Column) -> Column:
    """Struct (date, source): the latest of modification, publication, 1 January of the title's year."""
    candidates = F.array(
        F.struct(to_instant(modified).alias("at"), F.lit(0).alias("pref"), F.lit("dateModified").alias("source")),
        F.struct(to_instant(published).alias("at"), F.lit(-1).alias("pref"), F.lit("datePublished").alias("source")),
        F.struct(
            F.when(title_year.isNotNull(), F.make_timestamp_ntz(title_year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("at"),
            F.lit(-2).alias("pref"),
            F.lit("année du titre").alias("source"),
        ),
    )
    return let(
        F.array_max(F.filter(candidates, lambda c: c["at"].isNotNull())),
        lambda best: F.struct(
            F.least(best["at"], F.when(best["at"].isNotNull(), now)).alias("date"),
            F.coalesce(best["source"], F.lit("aucune")).alias("source"),
        ),
    )


def freshness_points(months: Column) -> Column:
    return F.when(months <= 6, 4).when(months <= 12, 3).when(months <= 24, 1).otherwise(0)
