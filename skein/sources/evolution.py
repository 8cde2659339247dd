"""Reading files of an older schema by field id: renames, promotions, new columns and initial defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Names of the table model's types that Spark has under another name or not at all (kept as numbers).
SPARK_TYPES = {"long": "bigint", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "time": "bigint", "timestamp_ns": "bigint", "timestamptz_ns": "bigint", "uuid": "string", "geometry": "binary", "geography": "binary"}


def spark_type(name: str) -> str:
    return "binary" if name.startswith("fixed") else SPARK_TYPES.get(name, name)


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: str
    initial_default: object = None
    required: bool = False


def read_as(df: DataFrame, ids: dict[int, str], fields: list[Field]) -> DataFrame:
    """The fields of a file whose columns have these ids. A field that the file lacks reads as its initial default; nulls
    that are stored stay null."""
    return df.select(*((F.col(f"`{ids[f.id]}`") if f.id in ids else F.lit(f.initial_default)).cast(spark_type(f.type)).alias(f.name) for f in fields))


def schema(fields: list[Field]) -> StructType:
    """A schema whose ids the Parquet reader resolves by (spark.sql.parquet.fieldId.read.enabled)."""
    from pyspark.sql.types import _parse_datatype_string

    return StructType([StructField(f.name, _parse_datatype_string(spark_type(f.type)), not f.required, {"parquet.field.id": f.id}) for f in fields])


def mapped_ids(columns: list[str], mapping: list[dict]) -> dict[int, str]:
    """Field ids of the columns of a file that carries none, by a name mapping: [{"field-id": 1, "names": ["a", "b"]}, ...]. A
    column that no entry names has no id; one that two entries name is an error."""
    by_name: dict[str, int] = {}
    for entry in mapping:
        for name in entry["names"]:
            if by_name.setdefault(name, entry["field-id"]) != entry["field-id"]:
                raise ValueError(f"{name} has two field ids")
    out: dict[int, str] = {}
    for c in columns:
        if c in by_name and out.setdefault(by_name[c], c) != c:
            raise ValueError(f"field {by_name[c]} has two columns")
    return out
