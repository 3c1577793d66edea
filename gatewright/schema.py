"""The findings table: one row per hit of one rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR, WARNING, INFO = "Error", "Warning", "Info"

FINDING = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("end_line_no", T.IntegerType()),
        T.StructField("actual", T.IntegerType()),
        T.StructField("threshold", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("fix", T.StringType()),
        T.StructField("steps", T.ArrayType(T.StringType())),
        T.StructField("example", T.StringType()),
        T.StructField("vars", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Absent text is empty and absent numbers are 0, never null: `threshold > 0`
# is how a report tells a measured finding from a plain one.
_BLANKS = {
    "string": "''",
    "int": "0",
    "bigint": "0L",
    "array<string>": "cast(array() as array<string>)",
    "map<string,string>": "cast(map() as map<string,string>)",
}


def as_findings(df: DataFrame, **given: Column | str | int) -> DataFrame:
    """Project any detector output onto the findings schema.

    `given` names the columns the rule states itself; other schema columns are
    taken from `df` when present and get their blank value when not.
    """
    out = []
    for field in FINDING.fields:
        dtype = field.dataType.simpleString()
        blank, value = _BLANKS[dtype], given.get(field.name)
        if isinstance(value, Column):
            column = F.coalesce(value.cast(field.dataType), F.expr(blank)).alias(field.name)
        elif value is not None:
            column = F.lit(value).cast(field.dataType).alias(field.name)
        elif field.name in df.columns:
            column = F.expr(f"coalesce(cast({field.name} as {dtype}), {blank}) as {field.name}")
        else:
            column = F.expr(f"{blank} as {field.name}")
        out.append(column)
    return df.select(*out)


def seq_of(id_col: Column, place: Column | int, width: int) -> Column:
    """Emit order as one number: by id, then by `place` below `width`.

    Very large ids wrap instead of overflowing. Wrapped ids still order the rows of one
    source among themselves, which is all reports ask for.
    """
    span = (2**63 - 1) // width
    return F.pmod(id_col.cast("bigint"), F.lit(span)) * F.lit(width) + place


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == ERROR, 3).when(severity == WARNING, 2).when(severity == INFO, 1).otherwise(0)
    )
