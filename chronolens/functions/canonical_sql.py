"""Canonical text compiled from a schema to one expression, so that packets are rendered and hashed without Python.

The text is that of canonical.canonical_text(): keys in order of their code points, no spaces, decimals as plain text of at
most 28 digits without trailing zeros, instants in UTC, days as ISO dates, and the shortest JSON escapes.

Defined cases: nulls of every kind are null; a type that has no one text (floating point, binary, intervals) and fields
that share a name are refused when the expression is built, whatever the values; maps are objects, their keys in order;
instants do not depend on the session's time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canonical import PRECISION, UnhashableValueError

DAY_MICROS = 86_400_000_000
# The short escapes of JSON; other control characters are written as four hexadecimal digits.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
RARE = {chr(k): f"\\u{k:04x}" for k in range(32) if chr(k) not in ESCAPES}


def _replaced(text: Column, table: dict[str, str]) -> Column:
    for char, escape in table.items():
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text


def _quoted(text: Column) -> Column:
    common = _replaced(text, ESCAPES)
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1F]"), _replaced(common, RARE)).otherwise(common), F.lit('"'))


def _decimal(value: Column, kind: T.DecimalType) -> Column:
    """Whole part and decimals are written apart, as casts of a whole decimal never use an exponent."""
    size, scale = F.abs(value), kind.scale
    whole = F.floor(size)
    if not scale:
        return F.concat(F.lit('"'), F.when(value < 0, "-").otherwise(""), whole.cast("string"), F.lit('"'))
    inner = T.DecimalType(scale + 1, scale)
    part = (size % F.lit(1).cast(T.DecimalType(1, 0))).cast(inner)
    if kind.precision > PRECISION:
        # Beyond 28 digits the last ones are rounded half to even; that may carry into the whole part.
        digits, cut = F.length(whole.cast("string")), part
        for n in range(PRECISION - scale + 1, kind.precision - scale + 1):
            cut = F.when(digits == n, F.bround(part, PRECISION - n).cast(inner)).otherwise(cut)
        whole, part = whole + F.floor(cut), (cut % F.lit(1).cast(T.DecimalType(1, 0))).cast(inner)
    digits = (part.cast(T.DecimalType(scale, scale)) * F.lit(10**scale).cast(T.DecimalType(scale + 1, 0))).cast(T.DecimalType(scale + 1, 0))
    tail = F.regexp_replace(F.lpad(digits.cast("string"), scale, "0"), "0+$", "")
    text = F.concat(whole.cast("string"), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)))
    return F.concat(F.lit('"'), F.when(value < 0, "-").otherwise(""), text, F.lit('"'))


def _instant(value: Column) -> Column:
    micros = F.unix_micros(value)
    rest = F.pmod(micros, F.lit(DAY_MICROS))
    day = F.date_from_unix_date(((micros - rest) / F.lit(DAY_MICROS)).cast("int")).cast("string")
    two = lambda unit, span: F.lpad((F.floor(rest / F.lit(unit)) % span).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(3_600_000_000, 24), two(60_000_000, 60), two(1_000_000, 60))
    part = rest % 1_000_000
    return F.concat(F.lit('"'), day, F.lit("T"), clock, F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(""), F.lit('+00:00"'))


def _object(value: Column, kind: T.StructType) -> Column:
    names = kind.fieldNames()
    if len(set(names)) < len(names):
        raise UnhashableValueError(f"fields share a name: {names}")
    parts: list[Column] = []
    for k, f in enumerate(sorted(kind.fields, key=lambda f: f.name)):
        key = _replaced_text(f.name)
        parts += [F.lit(("," if k else "{") + f'"{key}":'), rendered(value.getField(f.name), f.dataType)]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def _replaced_text(name: str) -> str:
    return "".join((ESCAPES | RARE).get(c, c) for c in name)


def _map(value: Column, kind: T.MapType) -> Column:
    if not isinstance(kind.keyType, T.StringType | T.IntegralType):
        raise UnhashableValueError(f"keys of type {kind.keyType.simpleString()} have no one text")
    entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), rendered(e["value"], kind.valueType).alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))


def rendered(value: Column, kind: T.DataType) -> Column:
    """JSON text of a value of the type, 'null' for null."""
    forms: list[tuple[type, Callable[[], Column]]] = [
        (T.StringType, lambda: _quoted(value)), (T.BooleanType, lambda: value.cast("string")), (T.IntegralType, lambda: value.cast("string")),
        (T.DecimalType, lambda: _decimal(value, kind)), (T.DateType, lambda: F.concat(F.lit('"'), value.cast("string"), F.lit('"'))), (T.TimestampType, lambda: _instant(value)),
        (T.StructType, lambda: _object(value, kind)), (T.MapType, lambda: _map(value, kind)),
        (T.ArrayType, lambda: F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: rendered(x, kind.elementType)), ","), F.lit("]"))),
    ]
    if isinstance(kind, T.NullType):
        return F.lit("null")
    for own, form in forms:
        if isinstance(kind, own):
            return F.when(value.isNull(), F.lit("null")).otherwise(form())
    raise UnhashableValueError(f"a {kind.simpleString()} has no one text")


def canonical_packet(rows: DataFrame, *fields: Column | str) -> Column:
    """Canonical text of an object of the named fields of rows."""
    packet = F.struct(*fields)
    return rendered(packet, rows.select(packet.alias("packet")).schema["packet"].dataType)
