"""Scratch tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Partitions that share a file of a gathered table where there are more than cores; bytes of its row groups, which tasks read one by one.
GATHER, ROW_GROUP = 4, 16_000_000


def scratch_dir(spark: SparkSession) -> str:
    """Inside the folder that the cluster names in spark.checkpoint.dir; a local run without one gets /tmp/checkpoints."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/corpusmill-{sc.applicationId}"


def written(df: DataFrame, gather: bool = False) -> DataFrame:
    """Write df as a scratch table and read it back: computed once, however often it is read.

    gather: one file a core, or one for GATHER partitions, instead of one a partition. Each file that a task creates may start
    processes (Hadoop's chmod where its native library is missing). Small row groups keep a writer's memory and the reading tasks as they
    are. Only for what streams: a task holds the sorted rows of all its partitions until it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    if gather:
        n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // GATHER)
        df.coalesce(n).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when the results that read them are stored."""
    jvm, path = spark.sparkContext._jvm, scratch_dir(spark)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
