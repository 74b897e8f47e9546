"""Canonical JSON of nested values: keys in order at every depth, two blanks of indentation, doubles in six significant digits, ASCII only.

The same values give the same bytes, whatever the order of columns, of a map's entries or of the cluster's tasks. What JSON cannot say, NaN and infinities, is found
beforehand and goes aside.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType, TimestampNTZType, TimestampType


def _bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: an array of one binds it."""
    return F.get(F.transform(F.array(c), use), 0)


def number(c: Column) -> Column:
    """Six significant digits in the shortest form: 0.0023, 42000.0, 1e-05, 1.5e+16."""
    sci = lambda x: F.format_string("%.5e", x)

    def shortest(x: Column) -> Column:  # of a value of six digits
        plain = F.regexp_replace(F.rtrim(F.format_string("%.9f", x), F.lit("0")), r"\.$", ".0")
        return F.when(x.isNull(), None).when(x == 0, "0.0").when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(F.regexp_replace(sci(x), r"\.?0*e", "e"))

    return _bound(sci(c.cast("double")).try_cast("double"), shortest)


def text(c: Column) -> Column:
    """A JSON string; what is not ASCII by its code units."""
    quoted = F.to_json(F.array(c))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(ch: Column) -> Column:
        n = F.ascii(ch).cast("bigint")
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
        return F.when(n < 0x80, ch).when(n < 0x10000, unit(n)).otherwise(pair)

    ascii_ = F.array_join(F.transform(F.split(quoted, ""), lambda ch: F.when(ch == "", ch).otherwise(escaped(ch))), "")
    return F.when(quoted.rlike(r"[^\x00-\x7F]"), ascii_).otherwise(quoted)


def render(c: Column, kind: DataType, depth: int = 0) -> Column:
    """The JSON text of a value that is not null. A struct's null fields are left out; an array's or map's nulls stay."""
    inner, outer = F.lit("\n" + "  " * (depth + 1)), F.lit("\n" + "  " * depth)
    # Whether it is empty is asked of the value: the items hold all that is below, and would be rendered again for it at each depth.
    wrap = lambda empty, items, a, b: F.when(empty, a + b).otherwise(F.concat(F.lit(a), inner, F.array_join(items, "," + "\n" + "  " * (depth + 1)), outer, F.lit(b)))
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        items = [F.when(c[f.name].isNotNull(), F.concat(text(F.lit(f.name)), F.lit(": "), render(c[f.name], f.dataType, depth + 1))) for f in fields]
        # Joining skips nulls.
        return wrap(reduce(and_, [c[f.name].isNull() for f in fields], F.lit(True)), F.array(*items).cast("array<string>"), "{", "}")
    if isinstance(kind, ArrayType):
        return wrap(F.size(c) == 0, F.transform(c, lambda x: F.when(x.isNull(), "null").otherwise(render(x, kind.elementType, depth + 1))), "[", "]")
    if isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(c))
        value = lambda k: F.try_element_at(c, k)
        item = lambda k: F.concat(text(k.cast("string")), F.lit(": "), F.when(value(k).isNull(), "null").otherwise(render(value(k), kind.valueType, depth + 1)))
        return wrap(F.size(c) == 0, F.transform(keys, item), "{", "}")
    if isinstance(kind, (DoubleType, FloatType)):
        return number(c)
    if isinstance(kind, (IntegralType, DecimalType, BooleanType)):
        return c.cast("string")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))
    if isinstance(kind, StringType):
        return text(c)
    raise TypeError(f"no JSON for {kind.simpleString()}")


def not_finite(c: Column, kind: DataType) -> Column:
    """Whether a NaN or an infinity is anywhere in a value; a null has none."""
    if isinstance(kind, (DoubleType, FloatType)):
        found = F.isnan(c) | (F.abs(c) == float("inf"))
    elif isinstance(kind, StructType):
        parts = [not_finite(c[f.name], f.dataType) for f in kind.fields]
        found = F.lit(False)
        for p in parts:
            found = found | p
    elif isinstance(kind, ArrayType):
        found = F.exists(c, lambda x: not_finite(x, kind.elementType))
    elif isinstance(kind, MapType):
        found = F.exists(F.map_values(c), lambda x: not_finite(x, kind.valueType))
    else:
        return F.lit(False)
    return F.coalesce(found, F.lit(False))


def serialize(df: DataFrame, columns: list[str], name: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Adds ``name``, the canonical JSON of ``columns`` as one object with a line end, and puts rows aside that hold what JSON cannot say."""
    whole = StructType([df.schema[c] for c in columns])
    doc = F.struct(*columns)
    bad = not_finite(doc, whole)
    return df.filter(~bad).withColumn(name, F.concat(render(doc, whole), F.lit("\n"))), df.filter(bad)
