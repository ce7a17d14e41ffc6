"""Column functions on dates typed as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coarse_date(text: Column) -> Column:
    """Year, month and day, or year and month, or year alone, from the start of a text; null where none fits."""
    t = F.trim(text.cast("string"))
    day = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_date(F.regexp_extract(t, r"^\d{4}-\d{1,2}-\d{1,2}", 0), "yyyy-M-d"))
    month = F.when(t.rlike(r"^\d{4}-\d{1,2}"), F.try_to_date(F.regexp_extract(t, r"^\d{4}-\d{1,2}", 0), "yyyy-M"))
    return F.coalesce(day, month, F.when(t.rlike(r"^\d{4}"), F.try_to_date(F.left(t, F.lit(4)), "yyyy")))


def typed_date(text: Column) -> Column:
    """A date in one of the forms people type (ISO, day first with / . or -, month names); null where none fits."""
    t = F.trim(text)
    forms = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"))
    return F.coalesce(*(F.when(t.rlike(p), F.try_to_date(t, f)) for p, f in forms))


def elapsed_years(quoted: Column, as_of: Column) -> Column:
    """Age in years of 365.25 days; 0 for dates that are missing, unreadable or in the future."""
    return F.coalesce(F.greatest(F.lit(0.0), F.datediff(as_of, coarse_date(quoted)) / F.lit(365.25)), F.lit(0.0))


def date_from_filename(name: Column) -> Column:
    """ISO text of a day-month-year, else a year-month-day, standing in a file name; null where there is none."""
    early, late = r"(\d{1,2})[-_](\d{1,2})[-_](\d{4})", r"(\d{4})[-_](\d{1,2})[-_](\d{1,2})"
    part = lambda p, i, n: F.lpad(F.regexp_extract(name, p, i), n, "0")
    return F.when(name.rlike(early), F.concat_ws("-", part(early, 3, 4), part(early, 2, 2), part(early, 1, 2))).when(name.rlike(late), F.concat_ws("-", part(late, 1, 4), part(late, 2, 2), part(late, 3, 2)))


def valid_until(quoted: Column, days: Column, as_of: Column) -> Column:
    return F.date_add(F.coalesce(coarse_date(quoted), as_of), days)


def year_of(text: Column) -> Column:
    return F.get(F.split(text, "-"), F.lit(0)).try_cast("int")


def due_date(issued: Column, terms_days: int) -> Column:
    return F.date_add(issued, terms_days)
