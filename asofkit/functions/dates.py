"""Date arithmetic of look-back and outcome windows (day precision)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def decimal_age(birth: ColumnLike, at: ColumnLike) -> Column:
    return F.date_diff(at, birth) / F.lit(365.25)


def window_start(index: ColumnLike, *, years: int | None = None, days: int | None = None) -> Column:
    """Calendar years (29 February falls back to the 28th) or plain days before the index date."""
    return F.add_months(index, -12 * years) if years is not None else F.date_sub(index, days or 0)


def window_end(index: ColumnLike, *, years: int | None = None, days: int | None = None) -> Column:
    """Last day of an outcome window that begins on the index day."""
    return F.date_sub(F.add_months(index, 12 * years), 1) if years is not None else F.date_add(index, (days or 1) - 1)


def covers(start: ColumnLike, end: ColumnLike, at: ColumnLike) -> Column:
    """Interval test with an open end."""
    start, end, at = (F.col(c) if isinstance(c, str) else c for c in (start, end, at))
    return (start <= at) & (end.isNull() | (end >= at))


def days_since(record: ColumnLike, index: ColumnLike) -> Column:
    return F.date_diff(index, record)


def parse_dates(raw: ColumnLike, formats: Sequence[str]) -> Column:
    """First declared Spark pattern that fits; a time, fraction or offset after the date is dropped, not shifted."""
    text = date_text(raw)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def parsed_format(raw: ColumnLike, formats: Sequence[str]) -> Column:
    """The pattern ``parse_dates`` used, NULL when none fits."""
    text = date_text(raw)
    return F.coalesce(*[F.when(F.try_to_timestamp(text, F.lit(f)).isNotNull(), f) for f in formats])


def date_text(raw: ColumnLike) -> Column:
    return F.regexp_replace(F.trim(raw), r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$", "")


def check_formats(formats: Sequence[str]) -> None:
    """Refuse a set in which one text could be read two ways (day and month swapped in the same layout)."""
    seen: dict[str, str] = {}
    for f in formats:
        layout = f.replace("dd", "#").replace("MM", "#").replace("d", "#").replace("M", "#")
        if layout in seen and seen[layout] != f:
            raise ValueError(f"ambiguous date formats {seen[layout]!r} and {f!r}")
        seen[layout] = f


def sentinel_to_null(col: ColumnLike, sentinels: Sequence[str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~c.isin(*[F.lit(s).cast("date") for s in sentinels]), c)


