"""Tables written between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.workspace import shared_folder


class Scratch:
    """One operator's tables. They outlive a lost executor, and `drop` removes those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
        path, files = self._at("")
        files.mkdirs(path)
        files.deleteOnExit(path)  # results may be read until the driver ends

    def _at(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df; what is returned reads the table."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._at(name)
            files.delete(path, True)
