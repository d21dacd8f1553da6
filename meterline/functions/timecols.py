"""Timestamps, buckets and the range language. Buckets floor; `div` would truncate."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
#: Ends of a bucket range that stand for "no bound"; stored buckets are BIGINT and may lie outside.
MAX_BUCKET = 4294967295
HOT_MAX_AGE_MS = 48 * HOUR_MS

# Strict ISO-8601 with a mandatory zone; the cast alone would also take dates and zoneless text.
_ISO = (r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d"
        r"(\.\d+)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)$")


def iso_to_ms(text: Column) -> Column:
    """Epoch ms of a strict ISO-8601 string, null for anything else. Fractions truncate to ms."""
    # Numeric zones are subtracted by hand: the cast refuses those beyond 18 hours.
    zone = F.regexp_replace(text, r"^.*([+-]\d\d):?(\d\d)$", "$1$2")
    minutes = F.substring(zone, 2, 2).cast("long") * 60 + F.substring(zone, 4, 2).cast("long")
    shift = F.when(zone.startswith("-"), -minutes).otherwise(minutes) * MINUTE_MS
    bare = F.regexp_replace(text, r"[+-]\d\d:?\d\d$", "Z")
    return F.when(text.rlike(_ISO), F.when(text.endswith("Z"), F.unix_millis(F.try_to_timestamp(text))).otherwise(
        F.unix_millis(F.try_to_timestamp(bare)) - shift))


def floor_div(value: Column, by: int) -> Column:
    """Floor division on integers, exact for the whole BIGINT range."""
    return F.call_function("div", value - F.pmod(value, F.lit(by).cast("long")), F.lit(by).cast("long"))


def minute_bucket(ts_ms: Column) -> Column:
    return floor_div(ts_ms, MINUTE_MS)


def hour_bucket(ts_ms: Column) -> Column:
    return floor_div(ts_ms, HOUR_MS)


def day_bucket(ts_ms: Column, tz_offset_min: int = 0) -> Column:
    return floor_div(ts_ms + F.lit(tz_offset_min * MINUTE_MS), DAY_MS)


def tier_bucket(tier: str, ts_ms: Column, tz_offset_min: int = 0) -> Column:
    """Minute and hour buckets are UTC, day buckets are local at a fixed offset."""
    if tier == "minute":
        return minute_bucket(ts_ms)
    if tier == "hour":
        return hour_bucket(ts_ms)
    if tier == "day":
        return day_bucket(ts_ms, tz_offset_min)
    raise ValueError(f"unknown tier {tier!r}")


def local_day_key(ts_ms: Column, tz_offset_min: int = 0) -> Column:
    """Unclamped local day, the key of the running rollups."""
    return floor_div(ts_ms + F.lit(tz_offset_min * MINUTE_MS), DAY_MS)


def local_hour_key(ts_ms: Column, tz_offset_min: int = 0) -> Column:
    """Local hour: nests in the local day for half-hour zones too."""
    return floor_div(ts_ms + F.lit(tz_offset_min * MINUTE_MS), HOUR_MS)


def day_of_hour(hour_key: Column) -> Column:
    return floor_div(hour_key, 24)


def hour_start_ms(hour_key: Column, tz_offset_min: int = 0) -> Column:
    return hour_key * F.lit(HOUR_MS) - F.lit(tz_offset_min * MINUTE_MS)


def day_start_ms(day_key: Column, tz_offset_min: int = 0) -> Column:
    return day_key * F.lit(DAY_MS) - F.lit(tz_offset_min * MINUTE_MS)


_TIER_MS = {"minute": MINUTE_MS, "hour": HOUR_MS, "day": DAY_MS}


def _tier_offset(tier: str, tz_offset_min: int) -> int:
    return tz_offset_min * MINUTE_MS if tier == "day" else 0


def bucket_start_ms(tier: str, bucket: Column, tz_offset_min: int = 0) -> Column:
    return bucket * F.lit(_TIER_MS[tier]) - F.lit(_tier_offset(tier, tz_offset_min))


def bucket_end_ms(tier: str, bucket: Column, tz_offset_min: int = 0) -> Column:
    """Last millisecond of a bucket."""
    return bucket_start_ms(tier, bucket + 1, tz_offset_min) - 1


def month_of_day(day_key: Column) -> Column:
    """First civil day of the month a local day key falls in."""
    return F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), day_key.cast("int")), "month")


# --- arguments of the query verbs; plain values that become literals -------------------

@dataclass(frozen=True)
class BucketRange:
    tier: str
    from_bucket: int
    to_bucket: int
    since_ms: int | None
    until_ms: int
    basis: str
    tz_offset_min: int


_UNIT_MS = {"s": 1000, "m": MINUTE_MS, "h": HOUR_MS, "d": DAY_MS, "w": 7 * DAY_MS}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def parse_when(text: str, now_ms: int) -> tuple[str, int]:
    """`now`, an age (`90m`, `-7d`), a civil date, an ISO instant or epoch ms.

    Returns ("ms", instant) or ("day", days since the epoch): a date becomes an
    instant only once the tier is known.
    """
    if text.lower() == "now":
        return "ms", now_ms
    age = re.fullmatch(r"-?(\d+)([smhdw])", text)
    if age:
        return "ms", now_ms - int(age[1]) * _UNIT_MS[age[2]]
    if re.fullmatch(r"\d+", text):
        return "ms", int(text)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return "day", (date.fromisoformat(text) - date(1970, 1, 1)).days
    zoned = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d)(:\d\d)?(\.\d+)?(Z|[+-]\d\d:?\d\d)?", text)
    if zoned and (zoned[2] or not (zoned[3] or zoned[4])):
        fraction = (zoned[3] or ".0")[1:4].ljust(3, "0")
        zone = (zoned[4] or "Z").replace("Z", "+00:00")
        at = datetime.fromisoformat(f"{zoned[1]}{zoned[2] or ':00'}.{fraction}000{zone}")
        return "ms", (at - _EPOCH) // timedelta(milliseconds=1)
    raise ValueError(f"not a time: {text!r}")


def _bucket_of(when: tuple[str, int], tier: str, tz_offset_min: int) -> int:
    kind, value = when
    if kind == "day" and tier == "day":
        bucket = value
    else:
        ms = value * DAY_MS if kind == "day" else value
        bucket = (ms + _tier_offset(tier, tz_offset_min)) // _TIER_MS[tier]
    return max(0, min(bucket, MAX_BUCKET))


def resolve_range(tier: str, now_ms: int, since: str | None = None, until: str = "now",
                  tz_offset_min: int = 0) -> BucketRange:
    """The inclusive bucket window a query scans; instants are derived from the buckets."""
    tz = tz_offset_min if tier == "day" else 0
    lo = _bucket_of(parse_when(since, now_ms), tier, tz) if since else 0
    hi = _bucket_of(parse_when(until, now_ms), tier, tz)
    step, shift = _TIER_MS[tier], _tier_offset(tier, tz)
    end = hi * step - shift if hi == MAX_BUCKET else (hi + 1) * step - shift - 1
    return BucketRange(tier, lo, hi, lo * step - shift if since else None, end,
                       "local" if tier == "day" else "utc", tz)
