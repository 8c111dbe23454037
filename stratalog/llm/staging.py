"""Tables written once into the folder that driver and executors share.

An operator that uses an intermediate result twice, or whose lineage would otherwise grow with
each round, writes it there and reads it back. A lost executor then costs a re-read, never a
recomputation of what was already decided.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A temporary folder serves where none is named and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB for Python tasks, where the session has Spark's default of 64 MB.

    Spark holds a batch on both sides of the pipe, for each task of an executor.
    """
    if spark.conf.get(_BATCH, None) in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(_BATCH, "8m")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/stratalog/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again: its lineage ends here."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of ``new_path`` that nothing will read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """The shuffle width the cluster is set to; bucket counts follow it, and so the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_hashed(rows: DataFrame, n: int, most: int, *key: str) -> DataFrame:
    """Of n rows those ``most`` whose key has the least hash. Rows that are sure to lie beyond them, by the share that is wanted, are
    dropped where they are, so what is put in order is a few times ``most`` rows in all, not in each partition."""
    lot = F.xxhash64(*key)
    bound = min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, 4 * most / max(n, 1))))
    return rows.filter(lot <= F.lit(bound)).orderBy(lot, *key).limit(most)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it for as long as ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_length(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the length of the text brought up to date, where it has such a column."""
    return docs.withColumn(length_col, F.length(text_col).cast("long")) if length_col in docs.columns else docs


def with_key(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """``docs`` with a long column ``name`` that tells its rows apart and ascends with the id, nulls last.

    The id serves where it is never null and never repeats. Only otherwise are the rows put in
    order (of one id by content, so that files and partitions do not matter), numbered from 0, and
    staged once, so that later reads agree.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if not ids.groupBy("id").count().filter("count > 1 or id is null").limit(1).take(1):
        return docs.withColumn(name, F.col(id_col).cast("long"))
    content, at, task = (fresh(docs, n) for n in ("_content", "_at", "_task"))
    rows = docs.withColumn(content, F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))).withColumn(at, F.monotonically_increasing_id())
    order = [F.col(id_col).cast("long").asc_nulls_last(), F.col(content), F.col(at)]  # unique, so that an id of many rows is split
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    held = staged(ranged.drop(content, at).withColumn(task, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "rows")
    tasks = held.groupBy(task).agg(F.count("*").alias("_n"), F.min(at).alias("_from"))  # a row for each task
    before = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(task, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    return held.join(F.broadcast(tasks), task).withColumn(name, F.col(at) + F.col("_shift")).select(*docs.columns, name)
