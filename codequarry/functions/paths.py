"""Path functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_key(path: Column) -> Column:
    """Same key for paths that agree ignoring case, slash direction and trailing slashes; NULL stays NULL."""
    return F.regexp_replace(F.lower(F.translate(path, "\\", "/")), "(?<=.)/+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1)


def ancestors(path: Column) -> Column:
    """All proper ancestor folders of a normalised path, longest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
