"""A folder of an operator's own in the shared folder, for tables that end with it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .common import shared_dir


class Workspace:
    """Tables written here end their lineage, so a lost executor costs no earlier step again.

    As a context, all of them go at its end; what outlives it is written with `result`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def store(self, df: DataFrame, name: str, mode: str = "errorifexists", **options) -> DataFrame:
        """`df`, written and read back."""
        df.write.mode(mode).options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def result(self, df: DataFrame) -> DataFrame:
        """`df`, written beside the workspace, where it stays for its readers."""
        path = f"{shared_dir(self.spark)}/{self.name}-result-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
