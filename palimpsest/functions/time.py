"""Session timestamps and relative time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.constants import MONTHS, WEEKDAYS

DAY = "struct<start:date,end:date,granularity:string,parse_status:string>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def session_timestamp(text: Column | str) -> Column:
    """``YYYY/MM/DD (Dow) HH:MM`` without its weekday; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(_col(text), r" \([^)]*\)", ""), F.lit("yyyy/MM/dd HH:mm"))


def session_date(text: Column | str) -> Column:
    """The first ten characters as a date with slashes or hyphens, else null."""
    return F.try_to_date(F.replace(F.substring(_col(text), 1, 10), F.lit("/"), F.lit("-")), "yyyy-MM-dd")


def lenient_anchor(text: Column | str) -> Column:
    """The day that a session's date names, with or without weekday and time; null where it names none."""
    return F.coalesce(F.to_date(session_timestamp(text)), session_date(text))


def _month_number(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for k in {m, m[:3]} for x in (k, i)])
    return F.try_element_at(known, F.lower(name))


def _safe_date(year: Column, month: Column, day: Column) -> Column:
    parts = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(month.isNotNull() & day.isNotNull(), F.try_to_date(parts, "yyyy-MM-dd"))


def _int(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def date_in_text(text: Column | str) -> Column:
    """The first ISO date in a text, else the first ``Month d, yyyy``, else null."""
    text = _col(text)
    # The forms of written dates.
    iso, named = r"\b(\d{4})[/-](\d{1,2})[/-](\d{1,2})\b", r"\b([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})\b"
    first = _safe_date(*[_int(F.regexp_extract(text, iso, i)) for i in (1, 2, 3)])
    second = _safe_date(_int(F.regexp_extract(text, named, 3)), _month_number(F.regexp_extract(text, named, 1)), _int(F.regexp_extract(text, named, 2)))
    return F.coalesce(first, second)


def _weekday_before(anchor: Column, day: int) -> Column:
    back = F.pmod(F.weekday(anchor) - F.lit(day), F.lit(7))
    return F.date_sub(anchor, F.when(back == 0, 7).otherwise(back).cast("int"))


def resolve_phrase(phrase: Column | str, anchor: Column | str) -> Column:
    """The date that a whole phrase means on the anchor's day; null for phrases that aren't listed.

    ISO dates; month and day with or without a year; today; yesterday or the day before; last month (its first day);
    last year; [about] n days, weeks, months or years ago (clamped to the month's end); last <weekday>, strictly before.
    """
    text, anchor = F.lower(F.trim(_col(phrase))), _col(anchor).cast("date")
    # The phrases that are understood.
    month = r"^([a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s*(\d{4}))?$"
    full = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    number = F.try_element_at(full, F.regexp_extract(text, month, 1))
    ago = r"^(?:about\s+)?(\d+)\s+(day|week|month|year)s?\s+ago$"
    n, unit = _int(F.regexp_extract(text, ago, 1)), F.regexp_extract(text, ago, 2)
    out = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    out = out.when(
        text.rlike(month) & number.isNotNull(),
        _safe_date(F.coalesce(_int(F.regexp_extract(text, month, 3)), F.year(anchor)), number, _int(F.regexp_extract(text, month, 2))),
    )
    out = out.when(text.isin("yesterday", "the day before"), F.date_sub(anchor, 1)).when(text == "today", anchor)
    out = out.when(text == "last month", F.trunc(F.add_months(anchor, -1), "MM")).when(text == "last year", F.add_months(anchor, -12))
    out = out.when(text.rlike(ago) & (unit == "day"), F.date_sub(anchor, n)).when(text.rlike(ago) & (unit == "week"), F.date_sub(anchor, n * 7))
    out = out.when(text.rlike(ago) & (unit == "month"), F.add_months(anchor, -n)).when(text.rlike(ago), F.add_months(anchor, -12 * n))
    for i, name in enumerate(WEEKDAYS):
        out = out.when(text.rlike(rf"^last\s+{name}$"), _weekday_before(anchor, i))
    return out


def time_of_text(text: Column | str, anchor: Column | str) -> Column:
    """struct(start, end, granularity, parse_status) of the time that a text speaks of: a written date, else today,
    yesterday, tomorrow, the week before last, last week, last month, previous or last Saturday, by the anchor's day."""
    text, anchor = _col(text), _col(anchor).cast("date")
    low, written = F.lower(text), date_in_text(text)
    monday = F.date_sub(anchor, F.weekday(anchor))

    def made(start: Column, end: Column | None = None, kind: str = "day") -> Column:
        return F.struct(
            start.alias("start"), (F.lit(None).cast("date") if end is None else end).alias("end"), F.lit(kind).alias("granularity"), F.lit("ok").alias("parse_status")
        ).cast(DAY)

    unknown = F.struct(F.lit(None), F.lit(None), F.lit("unknown"), F.lit("unparsed")).cast(DAY)
    month_end = F.date_sub(F.trunc(anchor, "MM"), 1)
    relative = (
        F.when(low.rlike(r"\btoday\b"), made(anchor))
        .when(low.rlike(r"\byesterday\b"), made(F.date_sub(anchor, 1)))
        .when(low.rlike(r"\btomorrow\b"), made(F.date_add(anchor, 1)))
        # as defined: the interval ends eight days before this week's Monday
        .when(low.contains("the week before last"), made(F.date_sub(monday, 14), F.date_sub(monday, 8), "week"))
        .when(low.contains("last week"), made(F.date_sub(monday, 7), F.date_sub(monday, 1), "week"))
        .when(low.contains("last month"), made(F.trunc(month_end, "MM"), month_end, "month"))
        .when(low.contains("previous saturday") | low.contains("last saturday"), made(_weekday_before(anchor, 5)))
        .otherwise(unknown)
    )
    return F.when(written.isNotNull(), made(written)).when(anchor.isNotNull(), relative).otherwise(unknown)
