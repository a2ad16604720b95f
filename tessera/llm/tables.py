"""Reading inputs, shared keys and schemas of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..session import materialize  # noqa: F401  (re-exported: written tables cut lineage)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of a table; works on any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def struct_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def with_column_struct(df: DataFrame, name: str, ddl: str) -> tuple[StructType, pa.Schema]:
    """(Spark, Arrow) schemas of ``df`` with one more struct column."""
    schema = StructType([*df.schema.fields, StructField(name, struct_of(ddl))])
    return schema, to_arrow_schema(schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(struct_of(ddl))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, key): key tells texts apart even where ids are null or repeated; equal rows share it."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("key"))
