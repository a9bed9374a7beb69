"""Names and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_header(name: str) -> str:
    """Column name of a raw header: encoding debris and units' marks out, lower snake case."""
    for junk in ("﻿", "â", "Â"):
        name = name.replace(junk, "")
    return re.sub(r"[().%°/]", "", name.strip().lower().replace(" ", "_"))


def station_name(col: Column) -> Column:
    """Parentheses out, blanks collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"[()]", ""), r"\s+", " "))


def unslug(col: Column) -> Column:
    return F.replace(col, F.lit("_"), F.lit(" "))


def calendar_id(location: Column, date: Column) -> Column:
    return F.concat_ws("_", F.lower(location), F.date_format(date, "yyyy_MM_dd"))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def repair_id(id_: Column, month: Column, day: Column) -> Column:
    """Append month and day to ids that do not end in ``_MM_DD``."""
    return F.when(id_.rlike(r".+_\d{2}_\d{2}$"), id_).otherwise(F.concat_ws("_", id_, _two(month), _two(day)))


def rebuild_id(id_: Column, month: Column, day: Column) -> Column:
    """Keep an id up to its first numeric token and append month and day; null without such a token."""
    parts = F.split(id_, "_")
    numeric = F.transform(parts, lambda p: p.rlike(r"^\d+$"))
    at = F.array_position(numeric, F.lit(True)).cast("int")
    base = F.array_join(F.slice(parts, 1, F.greatest(at, F.lit(1))), "_")
    return F.when(at > 0, F.concat_ws("_", base, _two(month), _two(day)))
