"""Writing an intermediate table once, where it is read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[DataFrame, str], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local session uses a temporary folder; a cluster has
    to name one, as its executors share no local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        folder = tempfile.mkdtemp(prefix="logsift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver's JVM ends."""
    root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    # Only what exists can be marked.
    files.mkdirs(path)
    files.deleteOnExit(path)
    return root


def parquet_stage(spark: SparkSession) -> Stage:
    """Writes a table to the shared folder and reads it back, which cuts its lineage.

    Plans over the result know its size. The files stay until the session ends, as a lazy
    result may read them until then.
    """
    root = scratch_folder(spark, "stage")

    def stage(df: DataFrame, name: str) -> DataFrame:
        at = f"{root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return stage
