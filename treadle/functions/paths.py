"""Path algebra as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_dir(path: Column) -> Column:
    """Everything before the last ``/``; ``""`` where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.when(path.isNotNull(), ""))


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def folded_path(path: Column) -> Column:
    """``.`` and ``..`` resolved; a ``..`` above the top is dropped."""
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def extension(path: Column) -> Column:
    """With its dot; ``""`` where there is none."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def python_module_path(module: Column, current_dir: Column) -> Column:
    """Dotted module to a path; leading dots climb from the current directory."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/")
    parts = F.split(current_dir, "/")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0)))
    above = F.array_join(kept, "/")
    return F.when(dots == 0, rest).otherwise(F.concat_ws("/", F.nullif(above, F.lit("")), F.nullif(rest, F.lit(""))))
