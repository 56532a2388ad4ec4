"""ISO-8601 instants, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


ISO = (
    r"^([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})[^0-9]"
    r"([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"(Z|[+-][0-9]{2}(?::?[0-9]{2})?)\z"
)
SECONDS_PER_DAY = 86400


def parse_instant(text: Column) -> Column:
    """Instant of an ISO text with an offset; null for a naive or unreadable text."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, ISO, i)

    def or_zero(c: Column) -> Column:
        return F.when(c == "", "00").otherwise(c)

    def normal_offset(o: Column) -> Column:
        digits = F.replace(F.substring(o, 2, 5), F.lit(":"), F.lit(""))
        return F.when(o == "Z", "+00:00").otherwise(
            F.concat(F.substring(o, 1, 1), F.substring(digits, 1, 2), F.lit(":"),
                     or_zero(F.substring(digits, 3, 2)))
        )

    normal = F.concat(
        part(1), F.lit("-"), part(3), F.lit("-"), part(4), F.lit(" "),
        part(5), F.lit(":"), or_zero(part(6)), F.lit(":"), or_zero(part(7)), F.lit("."),
        F.rpad(F.substring(part(8), 1, 6), 6, "0"), normal_offset(part(9)),
    )
    return F.when(text.rlike(ISO), normal.try_cast("timestamp"))


def age_days(instant: Column, as_of: Column) -> Column:
    """Days from ``instant`` to ``as_of`` (negative in the future)."""
    micros = F.unix_micros(as_of) - F.unix_micros(instant)
    return micros / F.lit(SECONDS_PER_DAY * 1_000_000.0)


def instant_literal(text: str) -> Column:
    """Timestamp constant from text that carries its offset."""
    return F.lit(text).cast("timestamp")


