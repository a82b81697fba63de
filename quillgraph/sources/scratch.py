"""Tables written in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
FILE_ROWS = 1 << 16


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one, for local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        holder = tempfile.TemporaryDirectory(prefix="quillgraph-")
        atexit.register(holder.cleanup)
        _own[app] = holder.name
    return _own[app]


class Scratch:
    """Writes tables under one folder of its own and reads them back.

    ``keep`` materialises a frame once as Parquet; where a bound ``most`` of its
    rows is known, in no more files than one for each FILE_ROWS of them, as many
    partitions may hold few rows (for rows of bounded size only). ``drop`` removes a table that no later step reads. Tables that a returned frame still reads stay until the
    owner of the shared folder cleans it.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/quillgraph-{what}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str = "t", most: int | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        written = df if most is None else df.coalesce(max(1, -(-most // FILE_ROWS)))
        written.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quillgraph_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._quillgraph_path)
            path.getFileSystem(conf).delete(path, True)


