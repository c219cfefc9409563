"""Materialised intermediate tables in the cluster's shared folder.

Iterative operators cut lineage by writing Parquet below the folder named in
``spark.checkpoint.dir`` and reading it back, so a lost executor costs one
task retry and never a recomputation from the start.  When the setting is
absent on a local master (unit tests) a folder of this process is used and the
setting is left alone; on a cluster its absence is an error, as executors do not
see each other's folders.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
#: Rows of an Arrow batch while a table is written: batches of long texts stay small.
ARROW_ROWS = 1000
#: Lets Spark remove an execution's shuffle files when it ends: a written table has no more use for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHUFFLES = "spark.sql.shuffle.partitions"
#: Bytes of text that one task takes apart.
TASK_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's, or on a local master one of this process if none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        folder = tempfile.mkdtemp(prefix="citeweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_ROOT.append("file://" + folder)
    return _LOCAL_ROOT[0]


def tasks_for(spark: SparkSession, size: int | None) -> int:
    """Parts for ``size`` bytes of text: the session's, or as many more as the size asks for."""
    return max(int(spark.conf.get(SHUFFLES)), -(-(size or 0) // TASK_BYTES))


class Store:
    """Tables of one operator call; ``drop`` removes those no longer needed.

    Shuffles of the tables written have at least ``parts`` parts, so that what
    one task holds does not grow with the input.
    """

    def __init__(self, spark: SparkSession, label: str, parts: int = 0):
        self.spark, self.schemas, self.parts = spark, {}, parts
        self.base = f"{scratch_root(spark)}/citeweave/{label}-{uuid.uuid4().hex[:12]}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a DataFrame that reads it back."""
        path = f"{self.base}/{name}"
        conf = self.spark.conf
        rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(min(rows, ARROW_ROWS) if rows > 0 else ARROW_ROWS), CLEANUP: "true"}
        if self.parts > int(conf.get(SHUFFLES)):
            own[SHUFFLES] = str(self.parts)
        before = {key: conf.get(key, None) for key in own}
        try:
            for key, value in own.items():
                conf.set(key, value)
            df.write.mode("overwrite").parquet(path)
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)
        self.schemas[name] = df.schema
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        """A fresh DataFrame over a table written before (with column identities of its own)."""
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables written by :meth:`put` (missing ones are ignored), and let shuffles of finished jobs go.

        Spark removes shuffle files when the driver collects the objects that
        stand for them, so a phase's end is the time to collect.
        """
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()
