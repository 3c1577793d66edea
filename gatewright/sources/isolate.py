"""Rows that fail to decode become error rows; the job goes on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def isolate_json(df: DataFrame, col: str, fields: Mapping[str, str]) -> DataFrame:
    """Decode a JSON column into typed columns plus `error`, null for good rows."""
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in fields] + [T.StructField("_corrupt", T.StringType())]
    )
    parsed = F.from_json(
        F.col(col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    out = df.withColumn("__json", parsed)
    error = F.when(F.col(col).isNull() | (F.trim(col) == ""), F.lit("empty"))
    error = error.when(F.col("__json._corrupt").isNotNull(), F.lit("malformed"))
    for name, dtype in fields.items():
        text = F.col(f"__json.{name}")
        error = error.when(
            text.isNotNull() & text.try_cast(dtype).isNull(), F.lit(f"bad value: {name}")
        )
    out = out.withColumn("error", error)
    for name, dtype in fields.items():
        out = out.withColumn(
            name, F.when(F.col("error").isNull(), F.col(f"__json.{name}").try_cast(dtype))
        )
    return out.drop("__json")


def split_good_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())
