"""Written intermediates in the folder that all executors share, and joins whose hot keys may be split."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; on a
    cluster a folder of each machine would give incomplete tables, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Whether Spark drops an action's shuffle files when it ends, and not when the driver happens to collect its plan.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession):
    """Inside, an action's shuffle files go when it ends: what it wrote is all that stays of it."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_END, before) if before is not None else spark.conf.unset(SHUFFLES_END)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: cuts the lineage of loops and survives a lost executor."""
    path = shared_path(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def freed(*frames: DataFrame) -> None:
    """Deletes the folders of ``written`` frames; nothing that is still to be computed may read them."""
    for df in frames:
        remove(df.sparkSession, df.written_at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this run made under ``shared_root``."""
    if not path.startswith(shared_root(spark) + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on one column; the extra key gives both sides exchanges that adaptive execution may split."""
    spread = F.xxhash64(F.col(key))
    return (
        left.withColumn("__spread", spread).join(right.withColumn("__spread", spread), ["__spread", key], how).drop("__spread")
    )


def in_order(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with ``place``, the number of each row (from 0) in the order of the columns ``order``.

    Rows are dealt by range and numbered where they lie; a row a partition gives the rest. Rows equal in all of
    ``order`` go to one task, so the last column should tell them apart where there may be many.
    """
    ordered = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id()),
        name,
    )
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = ordered.join(F.broadcast(sizes), "__part")
    out = placed.select(*df.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias("place"))
    out.written_at = ordered.written_at
    return out
