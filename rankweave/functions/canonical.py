"""Canonical JSON of nested values and the digests built on it.

Keys of structs and maps are sorted by code point, there is no white space, characters beyond ASCII stay as they are,
and a number that is not finite is an error. Values without floating-point parts are written by column expressions;
where a float occurs anywhere, one Arrow function writes the value, since the shortest decimal form is not what the JVM
prints. A null is ``null``; a map key is a string.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ids import json_string

#: Fixed value: the name of the array header's form.
ARRAY_SCHEMA = "anatomy-array-sha256-v1"


def _has_float(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_float(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_float(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_float(kind.valueType)
    return isinstance(kind, (T.FloatType, T.DoubleType))


def _string(x: Column) -> Column:
    """A JSON string. Control characters without a short form have lower-case hex digits, which the JVM's writer has not."""
    out = json_string(x)
    for code in (*range(0x0B, 0x10), *range(0x1A, 0x20)):
        if code not in (0x0C, 0x0D):  # \f and \r have short forms
            out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(x.rlike(r"[\x00-\x1f]"), out).otherwise(json_string(x))


def _json(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), _json(x[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: _json(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(x), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        body = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_string(e["key"]), F.lit(":"), _json(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        body = _string(x)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        body = x.cast("string")
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.when(x.isNotNull(), body).otherwise("null")


def plain(value, kind: T.DataType):
    """An Arrow value as Python's JSON writer takes it: maps come as pairs."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: plain(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [plain(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return {k: plain(x, kind.valueType) for k, x in value}
    return value


def canonical_json(df: DataFrame, column: str) -> Column:
    """The canonical JSON of a column of ``df``, whatever its type."""
    kind = df.schema[column].dataType
    if not _has_float(kind):
        return _json(F.col(column), kind)

    @F.arrow_udf("string")
    def dump(values):
        import pyarrow as pa

        return pa.array([json.dumps(plain(x, kind), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False) for x in values.to_pylist()], pa.string())

    return dump(F.col(column))


def canonical_hash(df: DataFrame, column: str) -> Column:
    return F.sha2(canonical_json(df, column), 256)


def without(df: DataFrame, column: str, *keys: str) -> Column:
    """A struct or map without these keys: what is compared or signed leaves out what names or batches it."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.MapType):
        return F.map_filter(column, lambda k, _: ~k.isin(*keys))
    left = [f.name for f in kind.fields if f.name not in keys]
    return F.when(F.col(column).isNotNull(), F.struct(*(F.col(column)[c].alias(c) for c in left)))


def signed(df: DataFrame, column: str, key: str = "artifact_sha256") -> DataFrame:
    """``column`` (a struct) with ``key`` set to the digest of all else in it."""
    bare = df.withColumn("__bare", without(df, column, key))
    kind = bare.schema["__bare"].dataType
    digest = canonical_hash(bare, "__bare")
    return bare.withColumn(column, F.when(F.col("__bare").isNotNull(), F.struct(*(F.col("__bare")[c].alias(c) for c in kind.fieldNames()), digest.alias(key)))).drop("__bare")


def signature_faults(df: DataFrame, column: str, key: str = "artifact_sha256") -> DataFrame:
    """Rows whose struct does not hold the digest of all else in it."""
    bare = df.withColumn("__bare", without(df, column, key))
    return bare.where(~canonical_hash(bare, "__bare").eqNullSafe(F.col(column)[key])).drop("__bare")


def array_digest(array: np.ndarray, kind: str) -> str:
    """SHA-256 over the digest of the array's canonical header, a line end, and its bytes in C order.

    ``mask``: zeros and ones as bytes. ``probabilities``: finite numbers in [0, 1] as little-endian doubles, not rounded.
    """
    if kind == "mask":
        if not np.isin(array, (0, 1)).all():
            raise ValueError("a mask holds zeros and ones")
        canonical = np.ascontiguousarray(array, np.uint8)
    elif kind == "probabilities":
        canonical = np.ascontiguousarray(array, "<f8")
        if not (np.isfinite(canonical).all() and (canonical >= 0).all() and (canonical <= 1).all()):
            raise ValueError("probabilities are finite and between 0 and 1")
    else:
        raise ValueError("kind is mask or probabilities")
    header = {"schema": ARRAY_SCHEMA, "kind": kind, "shape": list(canonical.shape), "dtype": canonical.dtype.str}
    named = hashlib.sha256(json.dumps(header, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    return hashlib.sha256(named.encode() + b"\n" + canonical.tobytes()).hexdigest()


def array_hash(values: Column, shape: Column, kind: str) -> Column:
    """The same for a flat array column and its shape; a length that the shape does not give is an error."""

    @F.arrow_udf("string")
    def digest(flat, shapes):
        import pyarrow as pa

        out = []
        for x, s in zip(flat.to_pylist(), shapes.to_pylist(), strict=True):
            if x is not None and len(x) != math.prod(s):
                raise ValueError("an array's length is not what its shape gives")
            out.append(None if x is None else array_digest(np.array(x).reshape(s), kind))
        return pa.array(out, pa.string())

    return digest(values, shape)
