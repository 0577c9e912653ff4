"""Time and score functions."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
#: `[2025-05-16 Fri 09:06]` with any day name, or none, and time optional.
BRACKETED = r"^[\[<](\d{4}-\d{2}-\d{2})(?:[^\d\]>]*(\d{1,2}:\d{2}))?[^\]>]*[\]>]$"


def epoch_ms_to_iso(ms: Column) -> Column:
    """ISO-8601 text in UTC; null and 0 give the empty text."""
    return F.when(ms.isNull() | (ms == 0), "").otherwise(F.date_format(F.timestamp_millis(ms.cast("long")), ISO))


def parse_time(text: Column, org_dates: bool = False) -> Column:
    """A timestamp, or null where the text is none; bracketed note dates only on request."""
    plain = F.when(F.regexp(text, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}|$)")), F.try_to_timestamp(text))
    if not org_dates:
        return plain
    day, clock = F.regexp_extract(text, BRACKETED, 1), F.regexp_extract(text, BRACKETED, 2)
    noted = F.when(day != "", F.try_to_timestamp(F.concat_ws(" ", day, F.when(clock != "", F.lpad(clock, 5, "0")).otherwise("00:00")), F.lit("yyyy-MM-dd HH:mm")))
    ident = F.when(F.regexp(text, F.lit(r"^\d{8}T\d{6}$")), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")))
    return F.coalesce(plain, noted, ident)


def age_days(at: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000.0)


def decay(score: Column, at: Column, as_of: Column, half_life_days: float) -> Column:
    """score halved every half_life_days; unknown times and half-lives up to 0 leave it."""
    if half_life_days <= 0:
        return score
    return F.when(at.isNull(), score).otherwise(score * F.exp(age_days(at, as_of) * F.lit(-log(2) / half_life_days)))


def similarity(distance: Column) -> Column:
    return F.coalesce(1.0 / (1.0 + distance), F.lit(0.0))


def min_max(score: Column, *by: str) -> Column:
    """score scaled to 0..1 within each group of `by`; 1 where all are equal."""
    over = Window.partitionBy(*by)
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))
