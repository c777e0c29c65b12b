"""Table sources and the shared folder for written intermediate tables."""
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its input comes in fewer pieces than there are (one small file); larger inputs are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the checkpoint folder of the context.

    Where neither is set, a local master gets a folder of its own below the temporary one; on any other master this raises,
    since executors on other machines could not read what is written there.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    set_already = sc._jsc.sc().getCheckpointDir()
    if not d and set_already.isDefined():
        d = set_already.get()
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = f"file://{tempfile.gettempdir()}/groundline-checkpoints-{os.getpid()}"
    if not set_already.isDefined():
        sc.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; Hadoop deletes it when the driver's JVM ends."""
    d = f"{shared_dir(spark)}/groundline-{spark.sparkContext.applicationId}"
    p, fs = hadoop_path(spark, d)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return d


def materialise(df: DataFrame, partition: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(partition) if partition else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of materialise that no later plan reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        p, fs = hadoop_path(df.sparkSession, path)
        fs.delete(p, True)
