"""JSON paths as text: ``.key`` for a member, ``[]`` for any array element, '' for the root.

In a key, ``~``, ``.`` and ``[`` are written ``~0``, ``~1`` and ``~2``, so that a path splits
into its steps in one way only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_key(key: Column) -> Column:
    out = F.replace(key, F.lit("~"), F.lit("~0"))
    out = F.replace(out, F.lit("."), F.lit("~1"))
    return F.replace(out, F.lit("["), F.lit("~2"))


def member_step_sql(key: str) -> str:
    return f"concat('.', replace(replace(replace({key}, '~', '~0'), '.', '~1'), '[', '~2'))"


# The step a row of ``variant_explode`` stands for: array elements have no key.
STEP_SQL = f"case when key is null then '[]' else {member_step_sql('key')} end"


def decode_key(key: Column) -> Column:
    out = F.replace(key, F.lit("~2"), F.lit("["))
    out = F.replace(out, F.lit("~1"), F.lit("."))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def member_step(key: Column) -> Column:
    return F.concat(F.lit("."), encode_key(key))


def steps_of(path: Column) -> Column:
    return F.filter(F.split(path, r"(?=[.\[])"), lambda s: s != "")


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.[^.\[]*|\[\])$", "")


def last_key(path: Column) -> Column:
    """Name of the member a path ends with."""
    return decode_key(F.regexp_extract(path, r"\.([^.\[]*)$", 1))


def is_member(path: Column) -> Column:
    return F.regexp_like(path, F.lit(r"\.[^.\[]*$"))


def is_item(path: Column) -> Column:
    return F.endswith(path, F.lit("[]"))


def ancestors_of(path: Column) -> Column:
    """All proper ancestors of a member path, the root left out."""
    steps = steps_of(path)
    return F.when(
        F.size(steps) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(steps) - 1),
            lambda n: F.concat_ws("", F.slice(steps, F.lit(1), n)),
        ),
    ).otherwise(F.array().cast("array<string>"))


# --- file paths -------------------------------------------------------------------------


def tidy(path: Column) -> Column:
    """Drop ``./`` parts and repeated slashes, as a path object would."""
    out = F.regexp_replace(path, r"/+", "/")
    out = F.regexp_replace(out, r"(?<=^|/)(\./)+", "")
    return F.regexp_replace(out, r"(?<=.)/\.?$", "")


def part(path: Column, n: int) -> Column:
    """The n-th part (from 0) of a file path; NULL when there is none."""
    clean = tidy(path)
    parts = F.filter(F.split(clean, "/"), lambda p: (p != "") & (p != "."))
    rooted = F.startswith(clean, F.lit("/"))
    parts = F.when(rooted, F.array_prepend(parts, "/")).otherwise(parts)
    return F.get(parts, F.lit(n))


def base_name(path: Column) -> Column:
    return F.regexp_extract(tidy(path), r"([^/]*)$", 1)


def parent_name(path: Column) -> Column:
    return F.regexp_extract(tidy(path), r"([^/]+)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot is no suffix."""
    name = base_name(path)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
