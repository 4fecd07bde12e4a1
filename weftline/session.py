"""Session settings that the operators rely on, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written tables.

    A cluster names it in ``spark.checkpoint.dir``; only where neither that
    setting nor an earlier call fixed a folder, and all work is in one process
    (tests), a temporary one is made.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder, which outlives any executor.

    Unlike a checkpoint, a Parquet table is read by column and planned with its
    real size; the size estimate kept by a checkpoint multiplies with every
    join of an iteration.
    """
    path = f"{shared_dir(df.sparkSession)}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str) -> DataFrame:
    """``written``, in as many buckets of ``key`` as a shuffle has partitions: grouping by it and joining on it shuffle nothing."""
    spark, name = df.sparkSession, f"weftline_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name.replace('_', '-')}"
    df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(name)  # one file a bucket
    return spark.table(name)


def written_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``written``, and how many rows were written, observed on the way."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` or ``written_by`` that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/weftline-" in path:
            spark.sql(f"drop table if exists weftline_{path.rpartition('/weftline-')[2]}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
