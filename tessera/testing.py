"""Result comparison used by the tests and the oracle checker: column names sorted,
row multisets compared exactly (outputs are rounded identically in both engines)."""

from __future__ import annotations

import datetime as dt
import decimal
import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v  # not a number is not missing
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    return [names[i] for i in order], out


# Spark and DuckDB type names mapped to one vocabulary, to compare result schemas.
SPARK_TYPES = {"IntegerType()": "INT32", "LongType()": "INT64", "DoubleType()": "DOUBLE", "StringType()": "STRING",
               "BooleanType()": "BOOL", "TimestampNTZType()": "TIMESTAMP", "TimestampType()": "TIMESTAMP",
               "DateType()": "DATE", "FloatType()": "FLOAT", "ShortType()": "INT16", "ByteType()": "INT8"}
DUCK_TYPES = {"INTEGER": "INT32", "BIGINT": "INT64", "DOUBLE": "DOUBLE", "VARCHAR": "STRING", "BOOLEAN": "BOOL",
              "TIMESTAMP": "TIMESTAMP", "DATE": "DATE", "FLOAT": "FLOAT", "SMALLINT": "INT16", "TINYINT": "INT8",
              "HUGEINT": "INT128"}


def type_mismatches(spark_df, rel) -> dict:
    """{column: (spark type, duckdb type)} for columns whose types differ."""
    st = {f.name: SPARK_TYPES.get(repr(f.dataType), repr(f.dataType)) for f in spark_df.schema.fields}
    dt = {n: DUCK_TYPES.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    return {c: (st.get(c), dt.get(c)) for c in sorted(set(st) | set(dt)) if st.get(c) != dt.get(c)}


def compare(spark_df, con, sql):
    """None when equal, else a short description of the first difference."""
    s_names, s_rows = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    types = type_mismatches(spark_df, rel)
    if types:
        return f"types {types}"
    d_names, d_rows = canonical(rel.columns, rel.fetchall())
    if s_names != d_names:
        return f"columns {s_names} != {d_names}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} != {len(d_rows)}"
    for a, b in zip(s_rows, d_rows):
        if a != b:
            return f"row {a} != {b}"
    return None
