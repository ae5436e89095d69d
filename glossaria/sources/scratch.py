"""Written tables in the folder that the driver and all executors share: they cut lineage, and lost executors cost a read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset and Spark runs on one machine.
FALLBACK = "/tmp/checkpoints/glossaria-core"
_folders: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, in a folder of this application that is deleted when it ends."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = FALLBACK
    own = f"{where.rstrip('/')}/catalogue/{spark.sparkContext.applicationId}"
    if own not in _folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of names (locales, files with uncommitted changes) is handed to every task.
FEW = 10_000


def small(names: DataFrame, most: int = FEW) -> DataFrame:
    """A table of names, for a broadcast if it has at most so many rows: they are fetched to see, one more at most. Else as it is, for Spark to choose."""
    rows = names.limit(most + 1).collect()
    return F.broadcast(names.sparkSession.createDataFrame(rows, names.schema)) if len(rows) <= most else names


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, dealt by some columns to as many tasks as shuffles have: however many rows a file has, few tasks may read it, too few for work on each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
