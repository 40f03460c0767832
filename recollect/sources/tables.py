"""Written tables: sinks, latest-row reads, and stages shared between jobs (IN8)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FOLDER_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Only a local session without such a setting gets a folder of its own.
    """
    folder = spark.conf.get(FOLDER_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {FOLDER_SETTING} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-recollect-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def write_table(
    df: DataFrame, path: str, parts: Sequence[str] = (), mode: str = "append"
) -> None:
    """Append (or overwrite) a parquet table, split into folders by ``parts``."""
    writer = df.write.mode(mode)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(path)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], order: str) -> DataFrame:
    """Latest row per key of an append-only table, in place of an in-place update.

    The aggregate combines before the shuffle, so a key with many versions costs one
    row per task. Of rows that are equal in ``order`` the last by content counts.
    """
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.to_json(F.struct(*rest)))).alias("_row"))
    return latest.select(*keys, "_row.*").select(*rows.columns)


def unless_missing(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` reads, None where nothing was written yet."""
    try:
        return read()
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def other_folders(spark: SparkSession, path: str, own: Mapping[str, object]) -> DataFrame | None:
    """The rows at ``path`` but for those in the folder that ``own`` names by column and value; None if there is no table yet.

    A batch that is run again so finds only what others wrote.
    """
    table = unless_missing(lambda: spark.read.option("basePath", path).parquet(path))
    if table is None:
        return None
    mine = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in own.items()])
    return table.filter(~mine)


def stage(df: DataFrame, name: str = "stage", **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later jobs start from the files, so that a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_parted(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stage``, with a folder for each value of ``key``: joins on it read only the folders they ask for."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(key).parquet(path)
    fields = [f for f in df.schema.fields if f.name != key] + [df.schema[key]]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def of_slots(stored: DataFrame, wanted: DataFrame, key: str = "slot") -> DataFrame:
    """The folders of ``stored`` (``stage_parted``) that a written ``wanted`` asks for.

    Spark prunes folders by a join only where the other side has a selective filter of its own, so the numbers of the
    folders are read first; there are as many at most as ``stored`` has folders.
    """
    numbers = sorted(r[key] for r in wanted.select(key).distinct().collect())
    return stored.filter(F.col(key).isin(numbers))


def stage_bucketed(
    df: DataFrame, name: str, key: str, buckets: int, sort: Sequence[str], spread: bool = False
) -> DataFrame:
    """Like ``stage``, split into ``buckets`` files by a hash of ``key``.

    Joins and aggregates on ``key`` then need no shuffle of this table. ``spread``
    says that ``df`` is already partitioned that way.
    """
    spark = df.sparkSession
    unique = f"recollect_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/recollect/{unique}"
    rows = df if spread else df.repartition(buckets, key)
    (
        rows.write.bucketBy(buckets, key)
        .sortBy(*sort)
        .option("path", path)
        .format("parquet")
        .saveAsTable(unique)
    )
    return spark.table(unique)
