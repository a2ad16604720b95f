"""File sources and sinks: CSV with a header, text with a multi-character delimiter."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NULL_MARK = "\\N"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; NULL is written as \\N so that empty strings survive a round trip."""
    df.write.mode("overwrite").option("header", True).option("nullValue", NULL_MARK).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, null_value: str = NULL_MARK) -> DataFrame:
    """Read CSV with a header.  Pass a schema (dirty columns as strings) instead of
    inferring one: inference costs a full extra pass over the files."""
    r = spark.read.option("header", True).option("nullValue", null_value).option("emptyValue", "")
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = "::") -> None:
    """One line per row, fields joined by ``sep`` (unquoted, as the ratings files); NULL is an empty field."""
    df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")) \
        .write.mode("overwrite").text(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = "::") -> DataFrame:
    """Split each line on a (multi-character) delimiter and type the fields by ``schema``.
    Fields that are empty, missing or do not parse become NULL."""
    parts = F.split(F.col("value"), re.escape(sep))
    cols = [F.expr(f"try_cast(nullif(trim(try_element_at(_p, {i + 1})), '') AS {f.dataType.simpleString()})")
            .alias(f.name) for i, f in enumerate(schema.fields)]
    return spark.read.text(path).select(parts.alias("_p")).select(*cols)
