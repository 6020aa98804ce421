"""Result tables: written as Parquet, CSV or JSON, and read back with a declared schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write one result table as a folder of part files, one per task."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        # Nested cells travel as JSON text in a delimited file.
        nested = [f.name for f in df.schema.fields
                  if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        writer = (df.withColumns({n: F.to_json(n) for n in nested}) if nested else df
                  ).write.mode(mode).option("header", True)
    writer.format(fmt).save(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> dict[str, str]:
    return {name: write_table(df, f"{folder}/{name}", fmt) for name, df in tables.items()}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read a stored result table. Text formats need the schema; Parquet carries its own."""
    if fmt != "parquet" and schema is None:
        raise ValueError(f"{fmt} tables are read with a declared schema")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def write_kpis(kpis: DataFrame, path: str) -> str:
    """KPI rows ``(kpi, point, lo, hi)`` as one JSON object with ``point`` and ``ci`` maps."""
    one = kpis.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kpi", "point")))).alias("point"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("kpi", F.array("lo", "hi").alias("ci"))))).alias("ci"))
    one.write.mode("overwrite").json(path)
    return path


def read_kpis(spark: SparkSession, path: str) -> DataFrame:
    schema = "point MAP<STRING, DOUBLE>, ci MAP<STRING, ARRAY<DOUBLE>>"
    one = spark.read.schema(schema).json(path)
    return (one.select(F.explode("point").alias("kpi", "point"), "ci")
            .select("kpi", "point", F.col("ci")[F.col("kpi")][0].alias("lo"),
                    F.col("ci")[F.col("kpi")][1].alias("hi")))
