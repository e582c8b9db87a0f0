"""Type labels, families, promotion and narrowing over Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Signed types by width; unsigned labels are those a column could be stored as elsewhere.
_WIDTH = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def label(t: T.DataType, metadata: dict | None = None) -> str:
    """A short, engine-neutral name of a type."""
    meta = metadata or {}
    if meta.get("label"):  # what a source recorded before widening
        return meta["label"]
    if type(t) in _WIDTH:
        return f"int{_WIDTH[type(t)]}"
    if isinstance(t, T.ArrayType):
        inner = label(t.elementType)
        return f"fixed_size_list<{inner}>[{meta['fixed_size']}]" if "fixed_size" in meta else f"list<{inner}>"
    if isinstance(t, T.DecimalType):
        return f"decimal128({t.precision}, {t.scale})"
    plain = {
        T.FloatType: "float32", T.DoubleType: "float64", T.BooleanType: "bool", T.StringType: "string", T.BinaryType: "binary", T.DateType: "date32",
        T.TimestampType: "timestamp[us, tz=UTC]", T.TimestampNTZType: "timestamp[us]", T.MapType: "map", T.StructType: "struct", T.NullType: "null",
        T.DayTimeIntervalType: "duration[us]", T.VariantType: "variant",
    }
    return next((name for kind, name in plain.items() if isinstance(t, kind)), t.simpleString())


def kind(t: T.DataType) -> str:
    """How a column is profiled: numeric, temporal, bool, string, binary, list, map or other."""
    if isinstance(t, T.NumericType):
        return "numeric"
    table = ((T.BooleanType, "bool"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "temporal"), (T.StringType, "string"), (T.BinaryType, "binary"), (T.ArrayType, "list"), (T.MapType, "map"))
    return next((k for types, k in table if isinstance(t, types)), "other")


def compatible(a: T.DataType, b: T.DataType) -> bool:
    """Whether two columns can hold the same logical values: widths within a family do not matter,
    families do, also where all values are null."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return a.names == b.names and all(compatible(x.dataType, y.dataType) for x, y in zip(a, b, strict=True))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return compatible(a.elementType, b.elementType)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return compatible(a.keyType, b.keyType) and compatible(a.valueType, b.valueType)
    whole = lambda t: type(t) in _WIDTH or isinstance(t, T.DecimalType) and t.scale == 0
    if whole(a) and whole(b):
        return True
    families = ((T.FloatType, T.DoubleType), (T.DecimalType,), (T.DateType,), (T.StringType, T.CharType, T.VarcharType), (T.BinaryType,), (T.TimestampType,), (T.TimestampNTZType,), (T.DayTimeIntervalType,))
    return any(isinstance(a, f) and isinstance(b, f) for f in families) or a == b


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: wider number, whole and fraction as double, anything unlike as string."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if type(a) in _WIDTH and type(b) in _WIDTH:
        return a if _WIDTH[type(a)] >= _WIDTH[type(b)] else b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            scale = max(a.scale, b.scale)
            return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widest(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        own, other = {f.name: f for f in a}, {f.name: f for f in b}
        fields = [T.StructField(n, widest(own[n].dataType, other[n].dataType) if n in own and n in other else (own.get(n) or other[n]).dataType) for n in dict.fromkeys([*own, *other])]
        return T.StructType(fields)
    dates = (T.DateType, T.TimestampNTZType)
    if isinstance(a, dates) and isinstance(b, dates):
        return T.TimestampNTZType()
    if isinstance(a, T.BinaryType) or isinstance(b, T.BinaryType):
        raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")
    return T.StringType()


def narrowest(low: int, high: int) -> str:
    """Label of the narrowest whole-number type that holds [low, high]; unsigned from zero on."""
    if low >= 0:
        return next(f"uint{bits}" for bits in (8, 16, 32, 64) if high < 1 << bits)
    return next(f"int{bits}" for bits in (8, 16, 32, 64) if -(1 << bits - 1) <= low and high < 1 << bits - 1)


#: Spark's own type for a narrowed label: unsigned ones take the next wider signed type.
STORED = {"uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint"}


def from_ddl(ddl: str, all_text: bool = False) -> T.StructType:
    """Columns of a CREATE TABLE statement. DECIMAL is read as double, unknown types as string."""
    known = {"smallint": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.DoubleType(), "real": T.DoubleType(), "decimal": T.DoubleType(), "numeric": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType()}
    body = re.search(r"\((.*)\)", ddl, re.DOTALL)
    if not body:
        raise ValueError("no column list in the statement")
    fields = []
    for part in re.split(r",(?![^(]*\))", body[1]):
        m = re.match(r'\s*(?:"([^"]+)"|(\S+))\s+(\w+)', part)
        if m and m[3].lower() not in ("key",):
            fields.append(T.StructField(m[1] or m[2], T.StringType() if all_text else known.get(m[3].lower(), T.StringType())))
    return T.StructType(fields)
