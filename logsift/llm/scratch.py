"""Tables that are read more than once, written to the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsift.plans.staging import scratch_folder


class Scratch:
    """Parquet tables below ``spark.checkpoint.dir``.

    Writing a table cuts its lineage, so a lost executor costs one re-read. Tables of
    finished rounds are removed by ``forget``; what a lazy result still reads goes when
    the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = scratch_folder(spark, "llm")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        files.delete(path, True)
