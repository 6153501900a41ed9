"""JSON found in model output."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Statements as stored.
STATEMENTS = "array<struct<statement:string,sentiment:string>>"
# What counts as the first array of objects, as the statements object, and as the widest object of a text.
ARRAY = r"(?s)\[\s*\{.*?\}\s*\]"
STATEMENTS_OBJECT = r'(?s)\{\s*"statements"\s*:\s*\[.*?\]\s*\}'
WIDEST_OBJECT = r"(?s)\{.*\}"


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_array(c: Column) -> Column:
    """Text of the first JSON array of objects inside a text."""
    return _or_null(F.regexp_extract(c, ARRAY, 0))


def first_statements(c: Column) -> Column:
    """Text of the ``{"statements": [...]}`` object, else of the widest object that has such a key."""
    exact = _or_null(F.regexp_extract(c, STATEMENTS_OBJECT, 0))
    wide = _or_null(F.regexp_extract(c, WIDEST_OBJECT, 0))
    return F.coalesce(exact, F.when(F.get_json_object(wide, "$.statements").isNotNull(), wide))


def parse_int_list(c: Column) -> Column:
    """An integer-list literal as an array; anything else is null."""
    return F.from_json(F.when(F.trim(c).rlike(r"^\[\s*(-?\d+\s*(,\s*-?\d+\s*)*)?\]$"), F.trim(c)), "array<bigint>")


def verdict(c: Column) -> Column:
    """``(atomicity, explainatoriness)`` from a strict verdict object; null for anything else."""
    found = F.from_json(c, "map<string,string>")
    exact = F.array_sort(F.map_keys(found)) == F.array(F.lit("atomicity"), F.lit("explainatoriness"))
    bit = lambda k: F.when(F.trim(found[k]).isin("1", "true"), 1).when(F.trim(found[k]).isin("0", "false"), 0)
    a, e = bit("atomicity"), bit("explainatoriness")
    return F.when(exact & a.isNotNull() & e.isNotNull(), F.struct(a.alias("atomicity"), e.alias("explainatoriness")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_objects(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every JSON object that can be decoded, left to right."""
    decoder = json.JSONDecoder()

    def scan(text):
        if text is None:
            return None
        out, at = [], text.find("{")
        while at >= 0:
            try:
                found, end = decoder.raw_decode(text, at)
            except ValueError:
                end = at + 1
            else:
                if isinstance(found, dict):
                    out.append(text[at:end])
            at = text.find("{", end)
        return out

    for s in batches:
        yield s.map(scan)


@F.pandas_udf(T.StringType())
def coerce_payload(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A ``{"statements": [...]}`` object from a list, a single statement, such an object or a literal; else an empty one."""

    def one(raw):
        value = None
        for read in (json.loads, ast.literal_eval):
            try:
                value = read(raw.strip())
                break
            except Exception:  # noqa: BLE001  any text may come
                continue
        if isinstance(value, list):
            value = {"statements": value}
        elif isinstance(value, dict):
            value = {"statements": [value]} if "statement" in value and "statements" not in value else value
        else:
            value = {"statements": []}
        return json.dumps(value, ensure_ascii=False)

    for s in batches:
        yield s.map(lambda x: one(x or ""))
