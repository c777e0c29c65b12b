"""A table kept between runs as numbered additions, each put in place by one rename."""
import uuid

from pyspark.sql import DataFrame, SparkSession

from .tables import hadoop_path


class Versions:
    """Additions v-0, v-1, ... in a folder. An addition is written aside and renamed to the next free number; the rename fails
    where that number exists, so of two runs at once the second must look again, and a run that dies leaves nothing visible."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def paths(self) -> list:
        p, fs = hadoop_path(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [f"{self.folder}/{n}" for n in sorted((n for n in names if n.startswith("v-")), key=lambda n: int(n[2:]))]

    def read(self, schema, paths: list | None = None) -> DataFrame:
        paths = self.paths() if paths is None else paths
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, make) -> list:
        """Commits make(paths of what is there); tried again on what is there then, if another run was first. The paths afterwards."""
        while True:
            there = self.paths()
            aside = f"{self.folder}/_aside-{uuid.uuid4().hex}"
            make(there).write.parquet(aside)
            src, fs = hadoop_path(self.spark, aside)
            dst = hadoop_path(self.spark, f"{self.folder}/v-{len(there)}")[0]
            hadoop = self.spark._jvm.org.apache.hadoop.fs
            none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            try:
                hadoop.FileContext.getFileContext(src.toUri(), self.spark._jsc.hadoopConfiguration()).rename(src, dst, none)
                return [*there, f"{self.folder}/v-{len(there)}"]
            except Exception:
                fs.delete(src, True)
                if self.paths() == there:
                    raise
