"""Sanitising of nested values: every string in a struct, array or map, wherever it lies.

The schema is walked once, when the plan is built, into one expression that lists the
strings of a row with their paths. The detectors go over that list within the row, so
nothing is dealt out or joined, and what they rewrote is put back by place. Keys of maps
and names of fields are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import redact

_NONE = "array<struct<at:string,path:string,text:string>>"


def _text(i: Column) -> Column:
    return i.cast("string")


def leaves(value: Column, kind: T.DataType, path: Column | None = None, at: Column | None = None) -> Column:
    """array of struct(at, path, text), in order of the fields. path: as it is shown (output.a[0].b); at: the same with
    the length before each key, so that no two strings of a row have one. Nulls are no strings."""
    path, at = F.lit("output") if path is None else path, F.lit("") if at is None else at
    none = F.array().cast(_NONE)
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), F.array(F.struct(at.alias("at"), path.alias("path"), value.cast("string").alias("text")))).otherwise(none)
    if isinstance(kind, T.StructType):
        own = [leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), F.concat(at, F.lit(f".{len(f.name)}:{f.name}"))) for f in kind]
        return F.concat(none, *own)
    if isinstance(kind, T.ArrayType):
        inner = lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("["), _text(i), F.lit("]")), F.concat(at, F.lit("["), _text(i), F.lit("]")))
        return F.coalesce(F.flatten(F.transform(value, inner)), none)
    if isinstance(kind, T.MapType):
        key = lambda e: _text(e["key"])
        inner = lambda e: leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), key(e)), F.concat(at, F.lit("."), _text(F.length(key(e))), F.lit(":"), key(e)))
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), inner)), none)
    return none


def _rebuilt(value: Column, kind: T.DataType, clean: Column, at: Column | None = None) -> Column:
    """value with the strings that ``clean`` (a map by ``at``) has for it."""
    at = F.lit("") if at is None else at
    if isinstance(kind, T.StringType):
        return F.coalesce(F.element_at(clean, at), value)
    if isinstance(kind, T.StructType):
        own = F.struct(*[_rebuilt(value[f.name], f.dataType, clean, F.concat(at, F.lit(f".{len(f.name)}:{f.name}"))).alias(f.name) for f in kind])
        return F.when(value.isNotNull(), own)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x, i: _rebuilt(x, kind.elementType, clean, F.concat(at, F.lit("["), _text(i), F.lit("]"))))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _rebuilt(v, kind.valueType, clean, F.concat(at, F.lit("."), _text(F.length(_text(k))), F.lit(":"), _text(k))))
    return value


def sanitized(df: DataFrame, column: str) -> DataFrame:
    """df with every string of ``column`` rewritten by all detectors, <column>_findings, and <column>_unsafe: the paths of
    the strings that had findings, in order."""
    kind = df.schema[column].dataType
    d = redact.sanitize_all(df.withColumn("_leaves", leaves(F.col(column), kind)), F.transform("_leaves", lambda x: x["text"]), "_clean", "_found")
    n = F.aggregate("_found", F.lit(0).cast("long"), lambda acc, x: acc + x)
    clean = F.map_from_entries(F.zip_with("_leaves", "_clean", lambda x, t: F.struct(x["at"], t)))
    unsafe = F.transform(F.filter("_leaves", lambda x, i: F.get("_found", i) > 0), lambda x: x["path"])
    return d.withColumns({column: F.when(n > 0, _rebuilt(F.col(column), kind, clean)).otherwise(F.col(column)), f"{column}_findings": n, f"{column}_unsafe": unsafe}).drop("_leaves", "_clean", "_found")


def serialized(value: Column, kind: T.StructType) -> Column:
    """value as JSON. A map of counters named matchCounts, at any depth of structs, becomes pairs if all of its names are
    known detectors' and its counts are safe whole numbers: so a detector's name isn't taken for an assignment."""

    def exempt(v: Column, k: T.DataType) -> list[Column]:
        out = []
        for f in k.fields if isinstance(k, T.StructType) else ():
            c = v[f.name]
            if f.name == "matchCounts" and isinstance(f.dataType, T.MapType):
                out.append(F.forall(F.map_entries(c), lambda e: e["key"].isin(*P.SECRET_TYPES) & e["value"].between(0, 2**53 - 1)))
            else:
                out += exempt(c, f.dataType)
        return out

    def paired(v: Column, k: T.StructType) -> Column:
        fields = []
        for f in k:
            c = v[f.name]
            if f.name == "matchCounts" and isinstance(f.dataType, T.MapType):
                c = F.transform(F.map_entries(c), lambda e: F.array(e["key"].cast("string"), e["value"].cast("string")))
            elif isinstance(f.dataType, T.StructType):
                c = paired(c, f.dataType)
            fields.append(c.alias(f.name))
        return F.struct(*fields)

    as_json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    known = F.lit(True)
    for c in exempt(value, kind):
        known = known & F.coalesce(c, F.lit(False))
    return F.when(known, as_json(paired(value, kind))).otherwise(as_json(value))


def failure_message(unsafe: Column) -> Column:
    """What an unsafe output's failure says: the first three paths, or that only the whole is unsafe."""
    shown = F.concat(F.lit("最终输出安全扫描失败（"), F.array_join(F.slice(unsafe, 1, 3), "、"), F.lit("）。"))
    return F.when(F.size(unsafe) > 0, shown).otherwise("最终序列化输出安全扫描失败。")


def assessed(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """df with <column>_failure: null, or what the failure of an unsafe output says: one that holds a string with findings,
    or whose JSON has some. where: rows in which the strings have to be looked at; the JSON is in all."""
    kind = df.schema[column].dataType
    listed = leaves(F.col(column), kind)
    d = df.withColumn("_leaves", listed if where is None else F.when(where, listed).otherwise(F.array().cast(_NONE)))
    texts = F.concat(F.transform("_leaves", lambda x: x["text"]), F.array(serialized(F.col(column), kind)))
    d = redact.sanitize_all(d, texts, "_clean", "_found")
    unsafe = F.transform(F.filter("_leaves", lambda x, i: F.get("_found", i) > 0), lambda x: x["path"])
    d = d.withColumn(f"{column}_failure", F.when(F.exists("_found", lambda n: n > 0), failure_message(unsafe)))
    return d.drop("_leaves", "_clean", "_found")
