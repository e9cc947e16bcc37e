"""Days, instants and seasons in Amsterdam. Instants are timestamps in UTC sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Amsterdam"
#: Days for which a confirmation holds, and days that an offer may lie ahead.
HOLDS_DAYS, AHEAD_DAYS = 90, 90
# The months of each season's dish.
SEASONS = {"asperges": (4, 5, 6), "mosselen": (9, 10, 11, 12, 1, 2, 3), "wild": (10, 11, 12), "pompoen": (9, 10, 11)}


def local_day(at: Column) -> Column:
    return F.from_utc_timestamp(at, ZONE).cast("date")


def at_local(day: Column, minute: Column | int) -> Column:
    """The instant at which clocks show that minute of a day, whatever the offset is then."""
    minutes = F.lit(minute) if isinstance(minute, int) else minute
    return F.to_utc_timestamp(F.timestamp_add("MINUTE", minutes.cast("int"), day.cast("timestamp")), ZONE)


def day_begin(at: Column) -> Column:
    """The instant at which the local day of an instant begins."""
    return at_local(local_day(at), 0)


def expiry(kind: Column, now: Column, closes: Column, end_day: Column, repeat_until: Column) -> Column:
    """The instant at which an offer expires, or null if its dates aren't allowed. closes: the minute of
    closing time, or null (then 23:59).

    A repeated offer lasts until closing time of its last day, one of a day until closing time today, a
    seasonal one until 23:59 of its last day. A last day mustn't be past, nor over 90 days ahead."""
    today, shut = local_day(now), F.coalesce(closes, F.lit(23 * 60 + 59))
    allowed = lambda d: F.datediff(d, today).between(0, AHEAD_DAYS)
    of_day = kind.isin("daghap", "dagmenu")
    return (
        F.when(repeat_until.isNotNull(), F.when(allowed(repeat_until), at_local(repeat_until, shut)))
        .when(of_day, at_local(today, shut))
        .when((kind == "seizoensgerecht") & allowed(end_day), at_local(end_day, 23 * 60 + 59))
    )


def online(expires: Column, now: Column, weekdays: Column, until: Column, sold_out: Column) -> Column:
    """struct(online, sold_out, reason) of an offer: expired, past its repetition, on another weekday
    (ISO numbers), sold out today, or online without a reason."""
    today = local_day(now)
    repeats = F.size(F.coalesce(weekdays, F.array().cast("array<int>"))) > 0
    reason = (
        F.when(expires.isNull() | (expires <= now), "expired")
        .when(repeats & (today > until), "past")
        .when(repeats & ~F.array_contains(weekdays, F.weekday(today) + 1), "other_day")
        .when(local_day(sold_out) == today, "sold_out")
    )
    return F.struct((reason.isNull() | (reason == "sold_out")).alias("online"), F.coalesce(reason == "sold_out", F.lit(False)).alias("sold_out"), reason.alias("reason"))


def confirmation(confirmed: Column, now: Column) -> Column:
    """struct(active, expires, days_left) of a confirmation, which holds for 90 times 24 hours; a day
    that has begun counts as left."""
    expires = F.timestamp_add("HOUR", F.lit(24 * HOLDS_DAYS), confirmed)
    left = F.unix_micros(expires) - F.unix_micros(now)
    days = F.ceil(F.greatest(F.coalesce(left, F.lit(0)), F.lit(0)) / 86_400_000_000).cast("int")
    return F.struct(F.coalesce(left > 0, F.lit(False)).alias("active"), expires.alias("expires"), days.alias("days_left"))


def seasons(day: Column) -> Column:
    """The seasons that run in a day's month, in their fixed order."""
    return F.filter(F.array(*[F.when(F.month(day).isin(*months), F.lit(name)) for name, months in SEASONS.items()]), lambda s: s.isNotNull())
