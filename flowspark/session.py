"""Session settings that suit this package; a cluster's own settings win."""

import gc
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Session aggregates keep a short port list per group; do not fall back to sorting early.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


def build_session(app_name="flowspark", master=None, **conf):
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark):
    """The folder every executor can reach that spark.checkpoint.dir names.

    Where the setting is missing, a folder beside the warehouse's tables serves, which a cluster
    shares as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return root.rstrip("/")


def work_dir(spark, name):
    """A new folder below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def forget_at_exit(spark, path):
    """Have the file system remove a folder when the application ends."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def materialise(df, name):
    """Write a table once to shared storage and go on from there.

    Cuts the lineage before work that passes over its input many times; unlike a cached table it
    outlives a lost executor. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    forget_at_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.work_path = path
    return table


def free_memory(spark):
    """Bytes of memory that the executors have left for stored data."""
    left = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().valuesIterator()
    total = 0
    while left.hasNext():
        total += left.next()._2()
    return total


def release(spark, *done):
    """Give back what a finished step held: tables of materialise that nothing reads any more, and broadcasts.

    Spark drops shuffles and broadcasts once no plan refers to them, which its driver notices when it
    collects garbage; a long job of many steps would keep them until then.
    """
    for thing in done:
        if hasattr(thing, "work_path"):
            path = spark._jvm.org.apache.hadoop.fs.Path(thing.work_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        else:
            thing.destroy()
    gc.collect()
    spark._jvm.System.gc()
