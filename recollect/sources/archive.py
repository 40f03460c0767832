"""Archive scans and the common item layout (IN1, IN2, IN6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recollect.schemas import FILE_INFO, ITEMS


def scan_archive(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Rows of an archive: a parquet, ORC or JSON export, or a folder of image files.

    An image folder (``fmt="files"``) gives one item per file: its path, name, size
    and modification time. Image bytes are not read.
    """
    if fmt == "files":
        return _scan_files(spark, path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "json":
        reader = reader.schema(ITEMS)
    return reader.format(fmt).load(path)


def _scan_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "modificationTime", "length")
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.xxhash64("path").alias("image_id"),
        F.col("path").alias("uri"),
        F.struct(name.alias("name"), F.col("length").alias("bytes")).alias("file_info"),
        F.create_map(
            F.lit("modified"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss")
        ).alias("meta"),
    )


def to_items(df: DataFrame) -> DataFrame:
    """The common columns, cast to their types. A column the source lacks becomes NULL."""
    have = set(df.columns)
    cols = []
    for field in ITEMS.fields:
        col = F.col(field.name) if field.name in have else F.lit(None)
        cols.append(col.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def normalize(*sources: DataFrame) -> DataFrame:
    """One table of items from any number of sources. Nothing is filled in."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [to_items(s) for s in sources]
    )


def land_source(df: DataFrame, source: str) -> DataFrame:
    """Items of an external source, in the common layout, under that source's name."""
    return to_items(df.withColumn("source", F.lit(source)))


__all__ = ["FILE_INFO", "land_source", "normalize", "scan_archive", "to_items"]
