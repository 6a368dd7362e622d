"""Time expressions: floored days, ISO text, dates in many written forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# The months, which may be shortened to three letters or more.
MONTHS = "january february march april may june july august september october november december".split()


def seconds(c: str | Column) -> Column:
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def floor_days(later: str | Column, earlier: str | Column) -> Column:
    """Whole days from earlier to later, floored (-30.5 days is -31), not calendar days."""
    return F.floor((seconds(later) - seconds(earlier)) / DAY)


def iso(c: str | Column) -> Column:
    """ISO text of a time; null stays null."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_date(c: str | Column) -> Column:
    """A written date, with or without time of day, as a timestamp; null if no known form fits.

    Forms: year-month-day and year.month.day (a time may follow), month/day/year, and day and month name in either
    order with a year (a time may stand before). `date=` before, `(UTC)` and a full stop after, and commas are allowed.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.lower(c), r"^date=|\(utc\)?\s*$|\s*utc$|\.\s*$", "")
    s = F.trim(F.regexp_replace(s, r"[,\s]+", " "))
    clock = r"(?:(\d{1,2}):(\d{2})(?::(\d{2}))? )?"
    forms = [  # pattern; groups of year, month, day, hour, minute, second
        (r"^(\d{4})([-.])(\d{1,2})\2(\d{1,2})(?:[ t](\d{1,2}):(\d{2})(?::(\d{2}))?z?)?$", (1, 3, 4, 5, 6, 7)),
        (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 1, 2, None, None, None)),
        (rf"^{clock}(\d{{1,2}})[ -]([a-z]+)[ -](\d{{4}})$", (6, 5, 4, 1, 2, 3)),
        (rf"^{clock}([a-z]+) (\d{{1,2}}) (\d{{4}})$", (6, 4, 5, 1, 2, 3)),
    ]
    number = F.create_map(*(x for i, m in enumerate(MONTHS) for n in {m, m[:3], *([m[:4]] if m == "september" else [])} for x in (F.lit(n), F.lit(i + 1))))

    def one(pattern: str, at: tuple) -> Column:
        part = lambda g: F.lit("0") if g is None else F.regexp_extract(s, pattern, g)
        num = lambda g: F.coalesce(part(g).try_cast("int"), F.lit(0))
        month = F.coalesce(part(at[1]).try_cast("int"), F.try_element_at(number, part(at[1])))
        return F.when(s.rlike(pattern), F.try_make_timestamp(num(at[0]), month, num(at[2]), num(at[3]), num(at[4]), num(at[5])))

    return F.coalesce(*(one(p, at) for p, at in forms))
