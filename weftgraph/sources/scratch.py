"""Cutting the lineage of iterative plans through reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and checkpointed in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables written once a session, by what they are made of.
_SAVED: dict[tuple, str] = {}


def saved(df: DataFrame, *key) -> DataFrame:
    """``df`` written once for this session and ``key``, and read from there.

    The key must name everything that ``df`` depends on; the files it reads and
    their times of change belong to it.
    """
    spark = df.sparkSession
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def state(path: str) -> tuple:
        at = jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(hadoop).getFileStatus(at)
        return path, status.getLen(), status.getModificationTime()

    full = (spark.sparkContext.applicationId, *key, *sorted(state(p) for p in df.inputFiles()))
    if full not in _SAVED:
        path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _SAVED[full] = path
    return spark.read.schema(df.schema).parquet(_SAVED[full])
