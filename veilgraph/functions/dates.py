"""FHIR dates: which can be shifted, and shifting them with their time of day as written."""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_TYPES = frozenset({"date", "dateTime", "instant"})
LAST = date.max.toordinal()
PARTIAL, INVALID = "partial_date_preserved", "invalid_date"

_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
#: Hours to 23, minutes to 59, seconds to 60; zones up to 14:00.
_TIME = r"T(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))"
_FORMS = {"date": re.compile(_DAY), "dateTime": re.compile(f"{_DAY}(?:{_TIME})?"), "instant": re.compile(_DAY + _TIME)}
_MONTH = re.compile(r"[0-9]{4}(?:-[0-9]{2})?")


@lru_cache(maxsize=1 << 14)
def _calendar(text: str) -> date | None:
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def classify(value: object, datatype: str) -> tuple[date | None, str | None]:
    """(day, None) of a date that can be shifted, else (None, why not)."""
    if isinstance(value, str):
        if datatype != "instant" and _MONTH.fullmatch(value):
            return None, PARTIAL if _calendar((value + "-01-01")[:10]) else INVALID
        if _FORMS[datatype].fullmatch(value) and (day := _calendar(value[:10])):
            return day, None
    return None, INVALID


@lru_cache(maxsize=1 << 16)
def _moved(day: str, days: int) -> str:
    return (date.fromisoformat(day) + timedelta(days=days)).isoformat()


def shift(value: str, days: int) -> str:
    return _moved(value[:10], days) + value[10:]


def bounds(day: date) -> tuple[int, int]:
    """Fewest and most days that the day can move and stay in years 1 to 9999."""
    return 1 - day.toordinal(), LAST - day.toordinal()


def classify_col(value: Column, datatype: str = "dateTime") -> Column:
    """'full', or why the date can't be shifted; as `classify`."""
    day = F.when(value.rlike(f"^{_DAY}"), F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"))
    form = {"date": _DAY, "dateTime": f"{_DAY}({_TIME})?", "instant": _DAY + _TIME}[datatype]
    valid = value.rlike(f"^{form}\\z") & day.isNotNull() & (F.substring(value, 1, 4) != "0000")
    month = F.try_to_date(F.substring(F.concat(value, F.lit("-01-01")), 1, 10), "yyyy-MM-dd")
    partial = value.rlike(r"^[0-9]{4}(-[0-9]{2})?\z")
    out = F.when(valid, F.lit("full"))
    if datatype != "instant":
        out = out.when(partial & month.isNotNull() & (F.substring(value, 1, 4) != "0000"), F.lit(PARTIAL))
    return out.otherwise(F.lit(INVALID))


def shift_col(value: Column, days: Column) -> Column:
    """The day moved, everything after it as written; years have four digits."""
    moved = F.date_add(F.to_date(F.substring(value, 1, 10), "yyyy-MM-dd"), days.cast("int"))
    return F.concat(F.date_format(moved, "yyyy-MM-dd"), F.substring(value, F.lit(11), F.length(value)))
