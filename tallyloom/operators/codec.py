"""Records as canonical JSON and back, with exact amounts.

JSON has no decimals, so an amount is written as text with two places, and its
path in the record under `decimal_paths`; what else looks like an amount stays
text.  Keys are sorted, nulls of a record are kept, those within its structs and
maps are left out, so a struct may have fields that only some records fill.

Reading asks for the schema of the record.  It refuses a record that lacks a
field or has another one, an amount that its path doesn't announce or that isn't
written with two places, and a path that leads to no amount or comes twice.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.scalars import exact_money

PATHS = "decimal_paths"
_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)


class Foreign(TypeError):
    """A record has a value that JSON would not give back."""


def _checked(t: T.DataType, where: str) -> bool:
    """Whether a type holds amounts; one that has no place in a record is refused."""
    if isinstance(t, T.DecimalType):
        return True
    if isinstance(t, (T.FloatType, T.DoubleType, *_PLAIN)):
        return False
    if isinstance(t, T.ArrayType):
        return _checked(t.elementType, f"{where}[]")
    if isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType):
        return _checked(t.valueType, f"{where}{{}}")
    if isinstance(t, T.StructType):
        return any([_checked(f.dataType, f"{where}.{f.name}") for f in t.fields])
    raise Foreign(f"{where}: no place for {t.simpleString()} in a record")


def _as_it_is(t: T.DataType) -> bool:
    """Whether to_json writes a type as a record has it."""
    if isinstance(t, T.ArrayType):
        return _as_it_is(t.elementType)
    if isinstance(t, T.StructType):
        names = [f.name for f in t.fields]
        return names == sorted(names) and all(_as_it_is(f.dataType) for f in t.fields)
    return isinstance(t, _PLAIN)


def _written(c: Column, t: T.DataType) -> Column:
    """c with amounts as text, maps in order of their keys; a number that is none is an error."""
    if _as_it_is(t):
        return c
    if isinstance(t, T.DecimalType):
        return exact_money(c)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("a number that is not finite")).cast("double")).otherwise(c.cast("double"))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _written(x, t.elementType))
    if isinstance(t, T.MapType):
        pairs = F.array_sort(F.transform(F.map_keys(c), lambda k: F.struct(k.alias("key"), _written(F.element_at(c, k), t.valueType).alias("value"))))
        return F.map_from_entries(pairs)
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_written(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name))))
    return c


def _paths(c: Column, t: T.DataType, at: Column) -> Column:
    """The paths of the amounts in c, each as a JSON list without its brackets."""
    none = F.array().cast("array<string>")
    if isinstance(t, T.DecimalType):
        return F.when(c.isNotNull(), F.array(at)).otherwise(none)
    if not _checked(t, ""):
        return none
    if isinstance(t, T.ArrayType):
        inner = F.flatten(F.transform(c, lambda x, i: _paths(x, t.elementType, F.concat(at, F.lit(","), i.cast("string")))))
    elif isinstance(t, T.MapType):
        quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
        inner = F.flatten(F.transform(F.map_keys(c), lambda k: _paths(F.element_at(c, k), t.valueType, F.concat(at, F.lit(","), quoted(k)))))
    else:
        inner = F.concat(*(_paths(c[f.name], f.dataType, F.concat(at, F.lit("," + json.dumps(f.name)))) for f in t.fields))
    return F.coalesce(inner, none)


def _all_paths(row: dict[str, Column], schema: T.StructType) -> Column:
    return F.array_sort(F.concat(F.array().cast("array<string>"), *(_paths(row[f.name], f.dataType, F.lit(json.dumps(f.name))) for f in schema.fields)))


def encoded(df: DataFrame, *columns: str) -> Column:
    """The columns of each row as a record."""
    schema = T.StructType([df.schema[c] for c in columns])
    if PATHS in columns:
        raise Foreign(f"{PATHS} is the record's own")
    for f in schema.fields:
        _checked(f.dataType, f.name)
    paths = F.concat(F.lit("[["), F.array_join(_all_paths({c: F.col(c) for c in columns}, schema), "],["), F.lit("]]"))
    # a field is written alone as {"v":...}, or as {} where it is null; a lambda's variable holds the text, so that it is made once
    listed = F.when(paths == "[[]]", F.lit("[]")).otherwise(paths) if _checked(schema, "") else F.lit("[]")
    alone = {f.name: F.to_json(F.struct(_written(F.col(f.name), f.dataType).alias("v"))) for f in schema.fields}
    alone[PATHS] = F.concat(F.lit('{"v":'), listed, F.lit("}"))
    names = sorted(alone)
    keys = F.array(*(F.lit(json.dumps(k) + ":") for k in names))
    told = lambda k, v: F.concat(k, F.when(v == "{}", "null").otherwise(F.substring(v, F.lit(6), F.length(v) - 6)))
    return F.concat(F.lit("{"), F.array_join(F.zip_with(keys, F.array(*(alone[k] for k in names)), told), ","), F.lit("}"))


def _as_text(t: T.DataType) -> T.DataType:
    """The type as it is written, amounts as strings."""
    if isinstance(t, T.DecimalType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_as_text(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(T.StringType(), _as_text(t.valueType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in t.fields])
    return t


def _read(c: Column, t: T.DataType) -> Column:
    if not _checked(t, ""):
        return c
    if isinstance(t, T.DecimalType):
        wrong = F.raise_error(F.concat(F.lit("not an amount of two places: "), c)).cast(t)
        return F.when(c.isNull() | c.rlike(r"^-?(0|[1-9][0-9]*)\.[0-9]{2}\z"), c.cast(t)).otherwise(wrong)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _read(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: _read(v, t.valueType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_read(c[f.name], f.dataType).alias(f.name) for f in t.fields)))
    return c


def decoded(text: Column, schema: T.StructType | str) -> Column:
    """A record's fields as a struct of that schema; a record that breaks a rule is an error when it is read."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    for f in schema.fields:
        _checked(f.dataType, f.name)
    names = sorted([*(f.name for f in schema.fields), PATHS])
    told = F.regexp_extract(text, r'"decimal_paths":\[(\[.*?\])?\](?:,"|\}\z)', 1)
    keys = F.sort_array(F.json_object_keys(text))
    raw = F.from_json(text, _as_text(schema), {"mode": "FAILFAST"})

    def checked(x: Column) -> Column:
        row = {f.name: x["raw"][f.name] for f in schema.fields}
        # what the record says, and what its amounts would have it say
        real = F.array_join(F.transform(_all_paths(row, schema), lambda p: F.concat(F.lit("["), p, F.lit("]"))), ",") if _checked(schema, "") else F.lit("")
        why = F.when(x["keys"].isNull(), "no record").when(x["keys"] != F.array(*map(F.lit, names)), "other fields than the schema's").when(x["told"] != real, "paths that are not its amounts'")
        fields = F.struct(*(_read(row[f.name], f.dataType).alias(f.name) for f in schema.fields))
        said = F.concat(F.lit("bad record, "), why, F.lit(": "), F.substring(F.coalesce(x["text"], F.lit("null")), 1, 200))
        return F.when(why.isNotNull(), F.raise_error(said).cast(fields_type(schema))).otherwise(fields)

    # a lambda's variable holds the parsed record, so that it is parsed once and not for each field
    parsed = F.struct(text.alias("text"), raw.alias("raw"), keys.alias("keys"), told.alias("told"))
    return F.transform(F.array(parsed), checked)[0]


def fields_type(schema: T.StructType) -> T.StructType:
    """The schema with every field open to null, as records are read."""

    def open_(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(open_(t.elementType))
        if isinstance(t, T.MapType):
            return T.MapType(t.keyType, open_(t.valueType))
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, open_(f.dataType)) for f in t.fields])
        return t

    return open_(schema)
