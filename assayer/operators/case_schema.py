"""Documents against an expected schema: every document is read as a variant, and what is there is told apart from what should be.

The check is one expression without a shuffle: where the schema has a structure, the variant must be an object, and its keys are
held against the fields; where it has an array, each element is visited with its place; leaves are held against their kinds.
Unexpected parts are told once, at their top, and are not descended into. Text that is no JSON is one issue, a null text none.
Parts whose type as a whole, as Spark infers it in one step, has no issue are not descended into either.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, FractionalType, IntegralType, StructType

from assayer.functions.text import let

FOUND = "struct<severity:string,code:string,field:string,message:string>"
NO_ISSUES = f"array<{FOUND}>"
#: Field names that types tell without quotes.
NAME = "[A-Za-z_][A-Za-z0-9_]*"
#: The kinds of variant values that a leaf may have, by the start of their names.
WHOLE, NUMBER, FLAG, TEXT = ("BIGINT", "INT", "SMALLINT", "TINYINT"), ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"), ("BOOLEAN",), ("STRING",)


def none() -> Column:
    return F.array().cast(NO_ISSUES)


def found(condition: Column, severity: str, code: str, field: Column | str, message: Column | str) -> Column:
    """One issue where the condition holds, else none; a null condition is none."""
    text = [x if isinstance(x, Column) else F.lit(x) for x in (F.lit(severity), F.lit(code), field, message)]
    made = F.array(F.struct(*[x.alias(n) for x, n in zip(text, ("severity", "code", "field", "message"), strict=True)])).cast(NO_ISSUES)
    return F.when(F.coalesce(condition, F.lit(False)), made).otherwise(none())


def all_of(*parts: Column) -> Column:
    """Issues in the order given; null parts have none."""
    return F.flatten(F.array(*[F.coalesce(p, none()) for p in parts]))


def kind(value: Column) -> Column:
    """BIGINT, STRING, OBJECT and so on."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def _kinds(wanted: DataType) -> tuple[str, ...]:
    if isinstance(wanted, BooleanType):
        return FLAG
    if isinstance(wanted, IntegralType):
        return WHOLE
    return NUMBER if isinstance(wanted, (FractionalType, DecimalType)) else TEXT


def _joined(path: Column, name: str) -> Column:
    return F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))


def _wrong(value: Column, wanted: str, path: Column) -> Column:
    return found(F.lit(True), "error", "SCHEMA_ERROR", path, F.concat(F.lit(f"expected {wanted}, found "), kind(value)))


def _fits(expected: DataType, required: Collection[str], spot: str, once: bool = True) -> str | None:
    """A pattern of the types, as schema_of_variant tells them, of parts without an issue. None if there is no such pattern.

    Types of an array's elements are merged, so required parts of elements are left to _held. Kinds of leaves merge to a kind that is
    as wide as both, so one that may not be there shows.
    """
    if isinstance(expected, StructType):
        parts = []
        for f in sorted(expected.fields, key=lambda f: f.name):
            here = f"{spot}.{f.name}" if spot else f.name
            needed, inner = once and here in required, _fits(f.dataType, required, here, once)
            if inner is None or not re.fullmatch(NAME, f.name):  # others are told in quotes
                return None
            parts.append(f"{f.name}: {inner}(?:, |(?=>))" if needed else f"(?:{f.name}: (?:{inner}|VOID)(?:, |(?=>)))?")
        return f"OBJECT<{''.join(parts)}>"
    if isinstance(expected, ArrayType):
        inner = _fits(expected.elementType, required, f"{spot}[]", False)
        return inner and f"ARRAY<(?:{inner}|VOID)>"
    return rf"(?:{'|'.join(_kinds(expected))})(?:\(\d+,\d+\))?"


def _held(value: Column, required: Collection[str], spot: str) -> Column | None:
    """Whether the elements of a part's arrays, whose types fit, have what they must have; None if this needs the elements one by one."""
    out = F.lit(True)
    for r in required:
        if not r.startswith((f"{spot}.", f"{spot}[]")) or "[]" not in r[len(spot) :]:
            continue
        way = re.fullmatch(rf"((?:\.{NAME})*)\[\]\.({NAME})", r[len(spot) :])
        if way is None:
            return None
        name = way[2]
        elements = F.try_variant_get(value, f"${way[1]}", f"array<struct<{name}:variant>>")
        out &= F.coalesce(F.forall(elements, lambda x: x.isNull() | (x[name].isNotNull() & ~F.is_variant_null(x[name]))), F.lit(True))  # noqa: B023
    return out


def _part(value: Column, expected: DataType, required: Collection[str], path: Column, spot: str, absent: Column) -> Column:
    """The issues of a part of a variant, those of absent if it is not there or null; taken apart only if its type tells of some."""
    pattern = _fits(expected, required, spot)

    def told(part: Column) -> Column:
        held, apart = _held(part, required, spot), drift(part, expected, required, path, spot)
        if pattern is None or held is None:
            return F.when(part.isNull() | F.is_variant_null(part), absent).otherwise(apart)
        return let(F.schema_of_variant(part), lambda t: F.when(t.isNull() | (t == "VOID"), absent).when(t.rlike(rf"\A{pattern}\z") & held, none()).otherwise(apart))

    return let(value, told)


def drift(value: Column, expected: DataType, required: Collection[str] = (), path: Column | None = None, spot: str = "") -> Column:
    """The issues of a variant. required: paths without places, such as `lines[].price`, that must have a value."""
    path = F.lit("") if path is None else path
    if isinstance(expected, StructType):

        def fields(m: Column) -> Column:
            parts = []
            for f in expected.fields:
                here = f"{spot}.{f.name}" if spot else f.name
                at = _joined(path, f.name)
                told = found(F.lit(here in required), "error", "SCHEMA_ERROR", at, "a required value is missing")
                parts.append(_part(m[f.name], f.dataType, required, at, here, told))
            more = F.sort_array(F.array_except(F.map_keys(m), F.array(*[F.lit(f.name) for f in expected.fields])))
            unknown = F.flatten(F.transform(more, lambda k: found(F.lit(True), "warning", "SCHEMA_ERROR", F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k)), "not in the schema")))
            return all_of(*parts, unknown)

        return let(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: F.when(m.isNull(), _wrong(value, "an object", path)).otherwise(fields(m)))
    if isinstance(expected, ArrayType):

        def each(x: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            return _part(x, expected.elementType, required, at, f"{spot}[]", none())

        items = F.try_variant_get(value, "$", "array<variant>")
        return let(items, lambda a: F.when(a.isNull(), _wrong(value, "an array", path)).otherwise(F.flatten(F.transform(a, each))))
    kinds = _kinds(expected)
    return F.when(kind(value).isin(*kinds), none()).otherwise(_wrong(value, kinds[0].lower() if kinds is not NUMBER else "a number", path))


def schema_issues(text: Column, expected: StructType, required: Collection[str] = ()) -> Column:
    """The issues of a JSON text."""
    return let(F.try_parse_json(text), lambda v: read_issues(text, v, expected, required))


def read_issues(text: Column, read: Column, expected: StructType, required: Collection[str] = ()) -> Column:
    """The issues of a JSON text that is read as a variant, which is null if it is no JSON."""
    failed = found(text.isNotNull(), "error", "SCHEMA_VALIDATION_FAILED", "", "the text is no JSON")
    return F.when(read.isNull(), failed).otherwise(drift(read, expected, required))
