"""Tables written between the steps of an operator.

Every intermediate table goes below ``spark.checkpoint.dir``, the folder that driver and executors
share; it cuts the lineage and outlives a lost executor.  Only where that setting is missing on a
single-process session (tests) is a temporary folder made and used instead.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; raises on a cluster that names none."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="thermogrid-")
    spark.conf.set(_SETTING, root)
    return root


class Workspace:
    """A folder for the intermediate tables of one call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/thermogrid/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` and read it back."""
        df.write.option("compression", "zstd").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        """Delete tables that nothing lazy reads any more."""
        jvm = self.spark.sparkContext._jvm
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(self.path(tag))
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores before those that ``columns`` have, in any case; for columns made on the way."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key() -> list:
    """Columns that tell rows of ``documents`` apart: its id and the digest of its text.

    Rows that agree on both are equal in every respect an operator looks at.
    """
    return [F.col("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha")]


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves remainder 0 by 5; False for a null id."""
    rest = F.crc32(F.col(column).cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(False))
