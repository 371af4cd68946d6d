"""Date parsing, period labels and period spines. All results are zone-free."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from zeitton.functions.text import bind

FREQUENCIES = ("D", "W", "M")
# Day.month.year, bullet, hour:minute; one or two digits except the year.
GERMAN_STAMP = r"(?U)^\d{1,2}\.\d{1,2}\.\d{4}\s+•\s+\d{1,2}:\d{1,2}\s+Uhr$"


def check_frequency(freq: str) -> str:
    if freq not in FREQUENCIES:
        raise ValueError(f"freq must be one of {FREQUENCIES}, got {freq!r}")
    return freq


def iso_day(text: Column) -> Column:
    return text.try_cast("date")


def day_text(day: Column) -> Column:
    return day.cast("date").cast("string")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MM.yyyy")


def german_timestamp(text: Column) -> Column:
    """Strict parse of ``01.12.2024 • 09:05 Uhr``; null for anything else."""

    def stamp(numbers: Column) -> Column:
        day, month, year, hour, minute = (F.get(numbers, i).try_cast("int") for i in range(5))
        return F.try_make_timestamp_ntz(year, month, day, hour, minute, F.lit(0).cast("decimal(16,6)"))

    found = F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0))
    return bind(F.when(text.rlike(GERMAN_STAMP), found), stamp)


def lenient_timestamp(text: Column) -> Column:
    """German stamp, else ISO date or date-time, else null."""
    return F.coalesce(german_timestamp(text), text.try_cast("timestamp_ntz"))


def period_end(when: Column, freq: str) -> Column:
    """Label of the period: the day, the Sunday closing its week, or the last day of its month."""
    day = when.cast("date")
    if check_frequency(freq) == "D":
        return day
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "Sun")
    return F.last_day(day)


def next_period(label: Column, freq: str) -> Column:
    if check_frequency(freq) == "D":
        return F.date_add(label, 1)
    if freq == "W":
        return F.date_add(label, 7)
    return F.last_day(F.date_add(label, 1))


def last_label(end: Column, freq: str) -> Column:
    """Latest period label not after ``end``."""
    if check_frequency(freq) == "D":
        return end
    if freq == "W":
        return F.date_sub(F.next_day(end, "Sun"), 7)
    return F.when(F.last_day(end) == end, end).otherwise(F.date_sub(F.trunc(end, "MM"), 1))


def spine(first: Column, last: Column, freq: str) -> Column:
    """All period labels between two labels, both included; empty when ``first`` is after ``last``."""
    empty = F.array().cast("array<date>")
    if check_frequency(freq) == "D":
        labels = F.sequence(first, last)
    elif freq == "W":
        labels = F.sequence(first, last, F.expr("interval 7 days"))
    else:
        months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
        labels = F.transform(months, F.last_day)
    return F.when(first <= last, labels).otherwise(empty)


def range_spine(start: Column, end: Column, freq: str) -> Column:
    """All period labels that fall inside ``[start, end]``."""
    return spine(period_end(start, freq), last_label(end, freq), freq)
