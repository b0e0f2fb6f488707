"""Written tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where it is unset, a local session gets a temporary one, and a cluster an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='headway-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def is_written(df: DataFrame) -> bool:
    """Whether the table that Scratch wrote for df is still there."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{df.scratch_folder}/_SUCCESS")
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(path)


def file_state(*tables: DataFrame) -> tuple:
    """The paths, sizes and times of the files that tables are read from: another state where any is written again."""
    spark, out = tables[0].sparkSession, []
    for name in sorted({f for t in tables for f in t.inputFiles()}):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


class Scratch:
    """Tables that one operator call writes and reads again, which cuts their lineage.

    They are Parquet in the shared folder, so that any executor can be lost;
    they go when the program ends, or at ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        """Write df and return it as read again."""
        self.n += 1
        folder = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        out.scratch_folder = folder
        return out

    def bucketed(self, df: DataFrame, *keys: str) -> DataFrame:
        """The same, dealt by keys into as many buckets as shuffles have partitions: a join on exactly these keys needs no shuffle of it."""
        self.n += 1
        folder, name = f"{self.root}/{self.n}", f"bucketed_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("compression", "zstd").option("path", folder).saveAsTable(name)
        atexit.register(self._forget, name)
        out = self.spark.table(name)
        out.scratch_folder = folder
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df.scratch_folder)

    def _forget(self, name: str) -> None:
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001  as below
            pass

    def _delete(self, folder: str) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone, and with it the need
            pass
