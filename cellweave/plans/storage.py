"""Tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, one machine alone (as in tests) gets a folder of its own, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="cellweave-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/cellweave-{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever file system the path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def cut(df: DataFrame, name: str = "cut", partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends, and a lost executor loses nothing."""
    return Scratch(df.sparkSession).cut(df, name, partition_by)


class Scratch:
    """A folder for one operator's intermediate tables, which go when they are freed."""

    def __init__(self, spark: SparkSession):
        self.spark, self._root, self._made = spark, shared_path(spark, "").rstrip("/"), 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        self._made += 1
        path = f"{self._root}/{self._made}-{name}"
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        done = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(done)] = (done, path)
        return done

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in tables:
            remove(self.spark, self._paths.pop(id(df))[1])
