"""Reading inputs, cutting lineage and sizing work, shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer pieces (a small table in one file); larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def long_rows(spark: SparkSession, rows: int = 2_000) -> None:
    """Arrow batches of some thousand rows, where the session does not say otherwise: ten thousand whole texts are too many.

    A batch lives in the JVM and in the Python worker at once, several times over while it grows.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset in a local session (tests) a folder of the session's warehouse stands in; on a cluster that folder could be
    each machine's own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/.llm").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    It cuts the lineage: what reads it survives the loss of executors without computing it again.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables made by ``written`` that nothing reads any more; what was written since stands on its own.

    The shuffle files behind them go as well: Spark's cleaner removes those of plans that the driver's garbage collection finds unused.
    """
    spark = None
    for df in tables:
        if df is not None and hasattr(df, "written_to"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            spark = df.sparkSession
    if spark is not None:
        spark._jvm.java.lang.System.gc()


#: Up to so many narrow rows are broadcast (some 25 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: A key with more than this share of a shuffle partition's rows is broadcast; there are at most 4 for each partition.
_HOT_SHARE = 4


def join_by_weight(rows: DataFrame, keys: DataFrame, on: str | list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, one narrow row for each key with the number of ``rows`` it has (``weight``, dropped).

    Few keys, counted, are broadcast. Of more, those with a large share of all rows are broadcast, as the shares bound their number;
    the others, each a small part of a shuffle partition, are shuffled. So no key makes a task of its own.
    """
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys.drop(weight)), on)
    most = max(total // (_HOT_SHARE * shuffle_partitions(rows.sparkSession)), 10_000)
    hot, cold = keys.where(F.col(weight) > most).drop(weight), keys.where(F.col(weight) <= most).drop(weight)
    shuffled = lambda r: r.join(cold.hint("shuffle_hash"), on)
    if hot.isEmpty():
        return shuffled(rows)
    return rows.join(F.broadcast(hot), on).unionByName(shuffled(rows.join(F.broadcast(hot.select(on)), on, "left_anti")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from one narrow scan; sizes sketches and buckets."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
