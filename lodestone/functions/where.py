"""The `where` language: nested dictionaries compiled to one Boolean column.

Values compare as JSON values do in Python: `True == 1 == 1.0`, text never
equals a number, lists and objects compare by content, and a missing key
equals `None`. Predicates are two-valued: they are true or false, never NULL.

Keys resolve either against typed columns (`TypedFields`), where the result is
a plain comparison that reaches the Parquet scan, or against one VARIANT
column (`VariantFields`).
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _known(predicate: Column) -> Column:
    """NULL counts as no match."""
    return F.coalesce(predicate, F.lit(False))


def _present(column: Column, test: Column) -> Column:
    """NULL counts as no match, in a form that reaches the Parquet scan."""
    return column.isNotNull() & test


def _is_number(value: Any) -> bool:
    return isinstance(value, (bool, int, float))


def _whole_bound(op: str, value: int | float) -> tuple[str, int] | bool:
    """Rewrite `whole <op> value` so that the operand is a whole number.

    Returns True or False where the comparison no longer depends on the row.
    """
    if isinstance(value, float):
        if math.isnan(value):
            return False
        if math.isinf(value):
            return op in ("lt", "lte") if value > 0 else op in ("gt", "gte")
        if op == "eq":
            return ("eq", int(value)) if value.is_integer() else False
        return (op, math.floor(value) if op in ("gt", "lte") else math.ceil(value))
    return (op, int(value))


def _float_bound(op: str, value: int | float) -> tuple[str, float] | bool:
    """Rewrite `real <op> value` so that the operand is an exact double."""
    if isinstance(value, float):
        return False if math.isnan(value) else (op, value)
    try:
        near = float(value)
    except OverflowError:
        return op in ("lt", "lte") if value > 0 else op in ("gt", "gte")
    if int(near) == value:
        return (op, near)
    if op == "eq":
        return False
    below = near if int(near) < value else math.nextafter(near, -math.inf)
    above = math.nextafter(below, math.inf)
    return ("lte", below) if op in ("lt", "lte") else ("gte", above)


def _compare(op: str, left: Column, right: Column) -> Column:
    return {
        "eq": lambda: left == right,
        "gt": lambda: left > right,
        "gte": lambda: left >= right,
        "lt": lambda: left < right,
        "lte": lambda: left <= right,
    }[op]()


def _compare_whole(op: str, column: Column, value: int | float) -> Column:
    bound = _whole_bound(op, value)
    if isinstance(bound, bool):
        return F.lit(bound) & column.isNotNull()
    op, operand = bound
    if operand > LONG_MAX or operand < LONG_MIN:
        above = operand > LONG_MAX
        return F.lit(op in ("lt", "lte") if above else op in ("gt", "gte")) & column.isNotNull()
    return _compare(op, column, F.lit(operand).cast("long"))


def _compare_real(op: str, column: Column, value: int | float) -> Column:
    bound = _float_bound(op, value)
    if isinstance(bound, bool):
        return F.lit(bound) & column.isNotNull() & ~F.isnan(column)
    op, operand = bound
    test = _compare(op, column, F.lit(operand))
    return test & ~F.isnan(column) if op in ("gt", "gte") else test


class TypedFields:
    """Metadata keys that are typed columns; other keys are missing in every row."""

    def __init__(self, columns: Mapping[str, tuple[Column, T.DataType]]):
        self.columns = dict(columns)

    @classmethod
    def of(cls, df: DataFrame, names: list[str] | None = None) -> "TypedFields":
        return cls({f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if names is None or f.name in names})

    def missing(self, key: str) -> Column:
        if key not in self.columns:
            return F.lit(True)
        return self.columns[key][0].isNull()

    def equal(self, key: str, value: Any) -> Column:
        if value is None:
            return self.missing(key)
        if key not in self.columns:
            return F.lit(False)
        column, kind = self.columns[key]
        if isinstance(kind, T.VariantType):
            return _variant_equal(column, value)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            return _variant_equal(F.to_variant_object(column), value)
        if isinstance(value, str):
            return _present(column, column == F.lit(value)) if isinstance(kind, T.StringType) else F.lit(False)
        return self.compare(key, "eq", value) if _is_number(value) else F.lit(False)

    def compare(self, key: str, op: str, value: Any) -> Column:
        if key not in self.columns or not _is_number(value):
            return F.lit(False)
        column, kind = self.columns[key]
        if isinstance(kind, T.VariantType):
            return _variant_compare(column, op, value)
        if isinstance(kind, T.IntegralType):
            return _present(column, _compare_whole(op, column, value))
        if isinstance(kind, T.BooleanType):
            return _present(column, _compare_whole(op, column.cast("long"), value))
        if isinstance(kind, T.DoubleType):
            return _present(column, _compare_real(op, column, value))
        if isinstance(kind, T.NumericType):
            return _present(column, _compare_real(op, column.cast("double"), value))
        return F.lit(False)

    def member(self, key: str, values: list[Any]) -> Column:
        if key not in self.columns:
            return F.lit(any(v is None for v in values))
        column, kind = self.columns[key]
        plain = []
        if isinstance(kind, T.StringType):
            plain = [v for v in values if isinstance(v, str)]
        elif isinstance(kind, T.IntegralType):
            bounds = [_whole_bound("eq", v) for v in values if _is_number(v)]
            plain = [b[1] for b in bounds if not isinstance(b, bool) and LONG_MIN <= b[1] <= LONG_MAX]
        else:
            return _any([self.equal(key, v) for v in values])
        tests = [_present(column, column.isin(plain))] if plain else []
        if any(v is None for v in values):
            tests.append(column.isNull())
        return _any(tests)


class VariantFields:
    """Metadata keys of one VARIANT column holding an object."""

    def __init__(self, metadata: Column):
        self.metadata = metadata

    def value(self, key: str) -> Column:
        if '"' not in key and "\\" not in key:
            return F.try_variant_get(self.metadata, f'$["{key}"]', "variant")
        if "'" not in key and "\\" not in key:
            return F.try_variant_get(self.metadata, f"$['{key}']", "variant")
        return F.try_variant_get(self.metadata, "$", "map<string,variant>")[key]

    def missing(self, key: str) -> Column:
        return _variant_equal(self.value(key), None)

    def equal(self, key: str, value: Any) -> Column:
        return _variant_equal(self.value(key), value)

    def compare(self, key: str, op: str, value: Any) -> Column:
        return _variant_compare(self.value(key), op, value)

    def member(self, key: str, values: list[Any]) -> Column:
        column = self.value(key)
        texts = [v for v in values if isinstance(v, str)]
        tests = [_known((_kind(column) == "STRING") & _get(column, "string").isin(texts))] if texts else []
        return _any(tests + [_variant_equal(column, v) for v in values if not isinstance(v, str)])


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _get(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _variant_compare(value: Column, op: str, operand: Any) -> Column:
    if not _is_number(operand):
        return F.lit(False)
    kind = _kind(value)
    whole_kind = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    real_kind = kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    bound = _whole_bound(op, operand)
    if isinstance(bound, bool) or abs(bound[1]) >= 10**38:
        constant = bound if isinstance(bound, bool) else _past_decimal(*bound)
        whole = flag = F.lit(constant)
    else:
        whole = _compare(bound[0], _get(value, "decimal(38,0)"), F.lit(str(bound[1])).cast("decimal(38,0)"))
        flag = _compare(bound[0], _get(value, "boolean").cast("decimal(38,0)"), F.lit(str(bound[1])).cast("decimal(38,0)"))
    real = _compare_real(op, _get(value, "double"), operand)
    return _known(
        F.when(whole_kind, whole).when(kind == "BOOLEAN", flag).when(real_kind, real).otherwise(F.lit(False))
    )


def _past_decimal(op: str, operand: int) -> bool:
    return op in ("lt", "lte") if operand > 0 else op in ("gt", "gte")


def _variant_equal(value: Column, operand: Any) -> Column:
    if operand is None:
        return value.isNull() | _known(_kind(value) == "VOID")
    if _is_number(operand):
        return _variant_compare(value, "eq", operand)
    if isinstance(operand, str):
        return _known((_kind(value) == "STRING") & (_get(value, "string") == F.lit(operand)))
    if isinstance(operand, list):
        items = _get(value, "array<variant>")
        same = [_variant_equal(F.get(items, F.lit(i)), v) for i, v in enumerate(operand)]
        return _known(_kind(value).startswith("ARRAY") & (F.size(items) == len(operand))) & _all(same)
    if isinstance(operand, dict):
        members = _get(value, "map<string,variant>")
        same = [
            _known(F.map_contains_key(members, k)) & _variant_equal(members[F.lit(k)], v) for k, v in operand.items()
        ]
        return _known(_kind(value).startswith("OBJECT") & (F.size(members) == len(operand))) & _all(same)
    return F.lit(False)


Fields = TypedFields | VariantFields


def compile_where(where: Mapping[str, Any] | None, fields: Fields, strict: bool = False) -> Column:
    """One Boolean column for a `where` dictionary; absent or empty matches all.

    Unknown operators match nothing, or raise when `strict` is set.
    """
    tests = []
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                tests.append(F.lit(False))
                continue
            parts = [compile_where(part, fields, strict) for part in value]
            tests.append(_all(parts) if key == "$and" else _any(parts))
        elif not isinstance(value, dict):
            tests.append(fields.equal(key, value))
        else:
            tests.extend(_operator(fields, key, op, operand, strict) for op, operand in value.items())
    return _all(tests)


def _operator(fields: Fields, key: str, op: str, operand: Any, strict: bool) -> Column:
    if op == "$eq":
        return fields.equal(key, operand)
    if op == "$ne":
        return ~fields.equal(key, operand)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return fields.compare(key, op[1:], operand)
    if op in ("$in", "$nin"):
        if not isinstance(operand, list):
            return F.lit(False)
        found = fields.member(key, operand)
        return found if op == "$in" else ~found
    if strict:
        raise ValueError(f"unknown operator {op!r} on {key!r}")
    return F.lit(False)


def compile_equality(where: Mapping[str, Any] | None, fields: Fields) -> Column:
    """Every key equals its value; dictionaries are values here, not operators."""
    return _all([fields.equal(key, value) for key, value in (where or {}).items()])
