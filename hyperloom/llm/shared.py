"""What the operators share: tables, work folders in the shared store, column hygiene."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to Python at once; a batch ends at either, so only a single longer text exceeds the bytes.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The named columns of a table; columns besides these, whatever their names, are left out."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch, and so a Python worker's memory.

    Plans read these two settings when they run, so they are lowered in the session; lower ones stay.
    """
    conf = spark._jsparkSession.sessionState().conf()
    for name, now, most in (("maxRecordsPerBatch", conf.arrowMaxRecordsPerBatch(), ARROW_ROWS), ("maxBytesPerBatch", conf.arrowMaxBytesPerBatch(), ARROW_BYTES)):
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    On a single machine without either a local one is made; a cluster without either is an error, since
    executors would write to their own disks.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    found = found or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="hyperloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Work:
    """A folder in the shared store for written intermediate tables.

    `keep` writes a frame and reads it back: the lineage is cut, each stage runs once, and a lost
    executor loses nothing. `drop` deletes a table that nothing reads any longer, and `settle` keeps an
    operator's result and deletes all else; what is left goes when the driver's process ends, because
    lazily evaluated results still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self._delete, self.path)

    def keep(self, frame: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.path}/{self._count:04d}"
        frame.write.parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept._work_path = path
        return kept

    def drop(self, frame: DataFrame) -> None:
        if path := getattr(frame, "_work_path", None):
            self._delete(path)

    def settle(self, frame: DataFrame) -> DataFrame:
        """The frame, kept; every table kept before is deleted."""
        kept = self.keep(frame)
        for k in range(1, self._count):
            self._delete(f"{self.path}/{k:04d}")
        return kept

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone at exit
            return


def text_column(name: str = "text"):
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))
