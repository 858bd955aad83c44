"""Tables in the folder that driver and executors share, and small helpers used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset a new local folder on a single machine, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Written tables that cut lineage.  Unlike ``checkpoint()`` a write computes its rows only once,
    and a lost executor costs no recomputation of what is already written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(written)] = path
        self.kept.append(written)  # so that no other table gets its id
        return written

    def remove(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing needs any more."""
        for t in tables:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(t)])
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name close to ``name`` that ``df`` does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, none where it is null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
