"""Parsing JSON text the strict way and naming what comes out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"
# Parsing stops at the end of the first value and ignores what follows. Wrapping the text with
# a closing mark shows whether the value was all there is: the mark must come back as item 1.
_MARK = "␂shapeloom-end␃"


def strip_bom(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit(BOM)), F.substring(text, 2, 2147483647)).otherwise(text)


def _floats_marked(text: Column) -> Column:
    """Large floats without a fraction spelt with an exponent, outside of strings.

    The parser turns ``12345678901234567890.0`` into a decimal and forgets the fraction's zeros;
    spelt with an exponent it stays a number that is not an integer.
    """
    tokens = F.regexp_extract_all(text, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[^"]++'), F.lit(0))
    marked = F.transform(
        tokens,
        lambda t: F.when(F.startswith(t, F.lit('"')), t).otherwise(F.regexp_replace(t, _LARGE_FLOAT, "$1e0")),
    )
    large = F.contains(text, F.lit(".0")) & F.regexp_like(text, F.lit(_LARGE_FLOAT))
    return F.when(large, F.array_join(marked, "")).otherwise(text)


_LARGE_FLOAT = r"([0-9]{19})\.0+(?![0-9.eE])"


def parse_strict(text: Column) -> Column:
    """The text as a variant, or NULL unless it is exactly one JSON value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), _floats_marked(text), F.lit(f',"{_MARK}"]')))

    def whole(items: Column) -> Column:
        return (F.size(items) == 2) & (F.try_variant_get(F.get(items, F.lit(1)), "$", "string") == _MARK)

    # Passed through an array, the parsed value is looked at three times but parsed once.
    items = F.array(F.try_variant_get(wrapped, "$", "array<variant>"))
    return F.get(F.transform(items, lambda i: F.when(whole(i), F.get(i, F.lit(0)))), F.lit(0))


# Fixed value: characters from which on a text that did not parse is looked at once more.
_LONG_TEXT = 1_000_000
# Stand for a pair of backslashes and an escaped quote while strings are told apart.
_PAIR, _QUOTE = "\ufdd0", "\ufdd1"


def _strings_shortened(text: Column) -> Column:
    """The text with its long strings cut down, names of members excepted.

    The engine's parser refuses strings of more than 20,000,000 characters. What a string says
    does not matter to the structure. One that is not valid becomes one that is not, either.
    NULL if the text holds the marks used here.
    """
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_PAIR)), F.lit('\\"'), F.lit(_QUOTE))
    parts = F.split(marked, '"')
    is_name = lambda i: F.regexp_like(F.coalesce(F.get(parts, i + 1), F.lit("")), F.lit(r"^\s*:"))
    faulty = lambda s: F.regexp_like(s, F.lit(r"[\x00-\x1f]|\\(?![/bfnrt]|u[0-9a-fA-F]{4})"))
    short = F.transform(
        parts,
        lambda s, i: F.when((i % 2 == 0) | (F.length(s) <= 64) | is_name(i), s)
        .when(faulty(s), F.lit("\\x"))
        .otherwise(F.lit("s")),
    )
    joined = F.replace(F.replace(F.array_join(short, '"'), F.lit(_QUOTE), F.lit('\\"')), F.lit(_PAIR), F.lit("\\\\"))
    return F.when(~F.contains(text, F.lit(_PAIR)) & ~F.contains(text, F.lit(_QUOTE)), joined)


def parse_structure(text: Column) -> Column:
    """As ``parse_strict``; in a text that only parses that way, long strings are cut down.

    The value then has the text's structure, but does not hold the document any more: strings are
    not to be read from it.
    """
    long = F.length(text) >= _LONG_TEXT
    return F.coalesce(parse_strict(text), F.when(long, parse_strict(_strings_shortened(text))))


def _is_one_value(text: Column) -> Column:
    # The streaming reader has no limit on the size of what it only counts.
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2, F.lit(False))


def reject_reason(text: Column, v: Column) -> Column:
    """Why ``v``, of ``parse_structure``, is NULL: ``too_large`` for the engine, or ``invalid``.

    NULL if there is a value.
    """
    large = (F.length(text) >= _LONG_TEXT) & _is_one_value(F.coalesce(_strings_shortened(text), text))
    return F.when(v.isNull(), F.when(large, "too_large").otherwise("invalid"))


def is_json(text: Column) -> Column:
    """Whether the text is exactly one JSON value, of any size."""
    large = (F.length(text) >= _LONG_TEXT) & _is_one_value(F.coalesce(_strings_shortened(text), text))
    return F.when(parse_strict(text).isNotNull(), True).otherwise(F.coalesce(large, F.lit(False)))


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that filters may refer to without computing it a second time.

    The optimizer moves a filter below the column it tests by repeating the expression; it does
    not do so across a generator.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))


def brace_slice(text: Column) -> Column:
    """First ``{`` through last ``}``, or NULL when there is no such span."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


# A struct cast succeeds for objects only and does not look at the members' content.
_IS_OBJECT = "try_variant_get({v}, '$', 'struct<`~`:int>') is not null"

# What Spark calls a scalar and what JSON Schema calls it. Integers too long for
# 64 bits arrive as decimals of 19 to 38 digits without a fraction. Every other decimal or
# double is a number, and so is 1.0, which arrives as DECIMAL(1,0).
_SCALAR_KINDS = {
    "STRING": "string",
    "BIGINT": "integer",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "ARRAY<VOID>": "array",
    **{f"DECIMAL({digits},0)": "integer" for digits in range(19, 39)},
}
_SCALAR_LOOKUP = "map({})".format(
    ", ".join(f"'{name}', '{kind}'" for name, kind in _SCALAR_KINDS.items())
)


def kind_sql(v: str) -> str:
    """SQL for the JSON Schema name of a variant's type.

    Containers are recognised without describing their content, so the cost does not grow with
    the size of the subtree.
    """
    return f"""case
        when {v} is null then null
        when {_IS_OBJECT.format(v=v)} then 'object'
        when try_variant_get({v}, '$[0]') is not null then 'array'
        else coalesce(element_at({_SCALAR_LOOKUP}, schema_of_variant({v})), 'number') end"""


def is_object_sql(v: str) -> str:
    return _IS_OBJECT.format(v=v)


def json_kind(v: str) -> Column:
    return F.expr(kind_sql(v))


def quote_json(text: Column) -> Column:
    """A string as JSON text, quotes included."""
    packed = F.to_json(F.array(text))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def quote_json_list(texts: Column) -> Column:
    return F.to_json(texts)


_write = json.JSONEncoder(ensure_ascii=False, check_circular=False).encode


def measure(text: str) -> tuple[int, int, int, int, int]:
    """Of one JSON value: its characters written by Python's ``json`` with default separators,
    non-ASCII kept, and how many members, levels, arrays and entries of arrays it has."""
    root = json.loads(text)
    members = arrays = entries = 0
    levels, front = 1, [root]
    while front:
        inside: list = []
        for x in front:
            if isinstance(x, dict):
                members += len(x)
                inside += x.values()
            elif isinstance(x, list):
                arrays += 1
                entries += len(x)
                inside += x
        levels += bool(inside)
        front = [x for x in inside if isinstance(x, (dict, list))]
    return len(_write(root)), members, levels, arrays, entries


@F.pandas_udf(T.LongType())
def _serialized_length(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(_write(json.loads(t))), na_action="ignore").astype("Int64")


def with_serialized_length(df: DataFrame, name: str, text: Column, v: Column) -> DataFrame:
    """Add the characters of the value written by Python's ``json`` with default separators,
    non-ASCII kept. ``text`` must be the one JSON value that ``v`` was parsed of."""
    return df.withColumn(name, _serialized_length(F.when(v.isNotNull(), F.make_valid_utf8(text))))


@F.pandas_udf(T.StringType())
def indented(text: pd.Series) -> pd.Series:
    """The value re-written with an indent of two blanks, non-ASCII escaped."""

    def rewrite(value: str | None) -> str | None:
        try:
            return json.dumps(json.loads(value), indent=2)
        except (TypeError, ValueError, RecursionError):
            return None

    return text.map(rewrite)


@F.pandas_udf(T.StringType())
def indented_unicode(text: pd.Series) -> pd.Series:
    """As ``indented``, non-ASCII kept; text that is not JSON comes back as it is."""

    def rewrite(value: str | None) -> str | None:
        try:
            return json.dumps(json.loads(value), indent=2, ensure_ascii=False)
        except (TypeError, ValueError, RecursionError):
            return value

    return text.map(rewrite)
