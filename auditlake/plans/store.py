"""Intermediate tables that outlive the executor that wrote them.

Iterative operators cut their lineage by writing a table to the folder that all executors share and reading it
again. The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset, as in tests,
a folder of this process is used instead, and only where driver and executors are one process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one if a local session names none, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    given = spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="auditlake-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return f"file://{_LOCAL[app]}"


class Store:
    """Tables written by one operator run, each under a path of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/auditlake/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write ``df`` and return the written table; later plans start from its files."""
        path, schema = f"{self.root}/{name}", df.schema
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        self.names.discard(name)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but ``names``, which are the operator's result."""
        for name in self.names - set(names):
            self.drop(name)
