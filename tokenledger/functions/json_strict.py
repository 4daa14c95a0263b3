"""Strict JSON decoding as column expressions.

A typed decoder fails a whole document on any wrong type, on text after the
value and on quoting Spark's reader would tolerate. ``strict_json`` reproduces
that with built-in expressions only:

* ``from_json`` with a corrupt-record column catches numeric/struct/array
  type errors (``1.5`` or ``"7"`` for an integer, ``[]`` for an object);
* string fields are parsed as strings; where the text could come from a
  number, boolean, object or array (``from_json`` turns ``123`` into
  ``'123'``), a variant parse checks that the JSON value was a string;
* the body is parsed as the one element of an array inside a small object,
  ``{"d":[`` body ``],"e":0}``: text behind the body, a bracket too many or a
  second value breaks that object, so the same parse tells them;
* a bare ``null`` document decodes to all-zero values, as a typed decoder does.

So each body is parsed once; the variant parse runs only for the rare text that
needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"
OPTIONS = {
    "columnNameOfCorruptRecord": BAD,
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "allowUnquotedFieldNames": "false",
    "allowComments": "false",
    "mode": "PERMISSIVE",
}


class Str(T.VariantType):
    """Marker type: a string field that must hold a JSON string (or null)."""


def _has_str(dt: T.DataType) -> bool:
    if isinstance(dt, Str):
        return True
    if isinstance(dt, T.StructType):
        return any(_has_str(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return _has_str(dt.elementType)
    return False


def _parse_type(dt: T.DataType, variant: bool = False) -> T.DataType:
    if isinstance(dt, Str):
        return T.VariantType() if variant else T.StringType()
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _parse_type(f.dataType, variant)) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_parse_type(dt.elementType, variant))
    return dt


# A string field parsed as ``string`` holds the JSON string, or the text of a
# number, true/false, object or array. Only text of those shapes needs the
# (slower) variant parse to tell which it was.
_FIRST_CHARS = list("-0123456789{[")


def _suspicious(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, Str):
        first = F.substring(c, 1, 1)
        return F.coalesce(first.isin(*_FIRST_CHARS) | c.isin("true", "false"), F.lit(False))
    if isinstance(dt, T.StructType):
        parts = [_suspicious(c[f.name], f.dataType) for f in dt.fields if _has_str(f.dataType)]
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return F.coalesce(c.isNotNull() & out, F.lit(False))
    return F.coalesce(F.exists(c, lambda x: _suspicious(x, dt.elementType)), F.lit(False))


def _types_ok(c: Column, dt: T.DataType) -> Column:
    """Over a variant parse: every string field holds a JSON string or null."""
    if not _has_str(dt):
        return F.lit(True)
    if isinstance(dt, Str):
        return c.isNull() | F.schema_of_variant(c).isin("STRING", "VOID")
    if isinstance(dt, T.StructType):
        checks = [_types_ok(c[f.name], f.dataType) for f in dt.fields if _has_str(f.dataType)]
        ok = checks[0]
        for ch in checks[1:]:
            ok = ok & ch
        return c.isNull() | ok
    return c.isNull() | F.forall(c, lambda x: _types_ok(x, dt.elementType))


def single_value(body: Column) -> Column:
    """True when ``body`` holds exactly one JSON value and nothing after it."""
    wrapped = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>", OPTIONS)
    return F.coalesce(F.size(wrapped) == 1, F.lit(False))


def parse_body(body: Column, schema: T.StructType) -> Column:
    """The one parse of a body (string fields as strings); materialise it as a
    column and read it with ``parse_ok`` and ``parse_value``."""
    whole = T.StructType([T.StructField("d", T.ArrayType(_parse_type(schema))), T.StructField("e", T.IntegerType()),
                          T.StructField(BAD, T.StringType())])
    return F.from_json(F.concat(F.lit('{"d":['), body, F.lit('],"e":0}')), whole, OPTIONS)


def parse_ok(parsed: Column) -> Column:
    """The body is one object of the schema's types, or ``null``; string
    fields are yet to be checked where ``suspicious``."""
    return F.coalesce(parsed[BAD].isNull() & (parsed["e"] == 0) & (F.size(parsed["d"]) == 1), F.lit(False))


def parse_value(parsed: Column) -> Column:
    """The body's struct; null for a ``null`` document."""
    return F.get(parsed["d"], F.lit(0))


def suspicious(value: Column, schema: T.StructType) -> Column:
    """True where some string field of a parsed value holds text that could
    stem from a non-string JSON value."""
    return _suspicious(value, schema)


def variant_check(value: Column, schema: T.StructType, body: Column) -> Column:
    """The variant parse of bodies whose string fields hold text of a
    non-string shape, else null."""
    return F.when(_suspicious(value, schema), F.from_json(body, _parse_type(schema, variant=True), OPTIONS))


def lit_true() -> Column:
    """``ok`` of a decode whose validity is tracked in a separate column."""
    return F.lit(True).alias("ok")


def strict_json(body: Column, schema: T.StructType) -> Column:
    """One-expression strict decode; returns ``struct<ok boolean, v struct>``.

    Convenient inside other expressions; jobs over tables use ``with_strict``,
    which keeps the parse and the flag as columns of their own.
    """
    parsed = parse_body(body, schema)
    value = parse_value(parsed)
    ok = parse_ok(parsed)
    if _has_str(schema):
        strict = F.from_json(body, _parse_type(schema, variant=True), OPTIONS)
        ok = ok & (~_suspicious(value, schema) | _types_ok(strict, schema))
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("v"))


_EXPRS: dict[tuple, Column] = {}


def _memo(key: tuple, build) -> Column:
    """Column expressions depend only on column names and schemas; build each
    once per application (saves thousands of JVM round trips per plan)."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    k = (sc.applicationId if sc is not None else None,) + key
    if k not in _EXPRS:
        _EXPRS[k] = build()
    return _EXPRS[k]


def with_stricts(df: DataFrame, body: str, decodes: dict[str, tuple[T.StructType, Column | None]]) -> DataFrame:
    """Add, for each ``out: (schema, guard)``, ``out`` = the decoded struct and
    ``out__ok``; rows whose guard is not true get neither (null, false).

    Four projections whatever the number of decodes: the parses, their values
    and flags, the rare variant parses, the verdicts."""
    b = F.col(body)

    def guarded(guard: Column | None, c: Column) -> Column:
        return c if guard is None else F.when(guard, c)

    df = df.withColumns({f"{o}__p": guarded(guard, _memo(("parse", body, schema.json()), lambda: parse_body(b, schema)))
                         for o, (schema, guard) in decodes.items()})
    df = df.withColumns({k: c for o in decodes for k, c in (
        (f"{o}__v", _memo(("value", o), lambda: parse_value(F.col(f"{o}__p")))),
        (f"{o}__a", _memo(("alone", o), lambda: parse_ok(F.col(f"{o}__p")))))})
    checked = [o for o, (schema, _) in decodes.items() if _has_str(schema)]
    if checked:
        df = df.withColumns({f"{o}__c": _memo(("check", o, body, decodes[o][0].json()), lambda: variant_check(
            F.col(f"{o}__v"), decodes[o][0], b)) for o in checked})
    oks = {o: F.col(f"{o}__a") for o in decodes}
    for o in checked:
        oks[o] = oks[o] & _memo(("types", o, decodes[o][0].json()), lambda: F.col(f"{o}__c").isNull()
                                | _types_ok(F.col(f"{o}__c"), decodes[o][0]))
    df = df.withColumns({f"{o}__ok": c for o, c in oks.items()})
    df = df.withColumns({o: F.when(F.col(f"{o}__ok"), F.col(f"{o}__v")) for o in decodes})
    return df.drop(*[f"{o}__{k}" for o in decodes for k in "pvac"])


def with_strict(df: DataFrame, body: str, schema: T.StructType, out: str, guard: Column | None = None) -> DataFrame:
    """Add ``out`` = struct<ok, v> strict decode of ``body`` (null where the
    guard is not true)."""
    df = with_stricts(df, body, {f"{out}__d": (schema, guard)})
    done = F.struct(F.col(f"{out}__d__ok").alias("ok"), F.col(f"{out}__d").alias("v"))
    return df.withColumn(out, done if guard is None else F.when(guard, done)).drop(f"{out}__d", f"{out}__d__ok")
