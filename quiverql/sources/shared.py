"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (tests in local mode) a temporary folder is
    made once per context; on a cluster its absence is an error, because a
    machine-local folder would not be seen by the executors.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='quiverql-')}")
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


class SharedPath:
    """A path of its own in the shared folder. ``drop`` deletes it; else it goes when the driver's file system is closed, at the latest when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.path = f"{shared_dir(spark)}/quiverql/{uuid.uuid4().hex}"
        self._place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._place.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._place)

    def drop(self) -> None:
        self._files.delete(self._place, True)
        self._files.cancelDeleteOnExit(self._place)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the shared folder.

    Spark deletes the files when the frame is no longer referenced (with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
