"""Small files on whatever file system Spark uses."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def is_file(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def names(self, folder: str) -> list[str]:
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def write_json(self, path: str, value: Any, overwrite: bool = False) -> None:
        """Written beside and renamed, so that readers see all or nothing; an error if it exists already."""
        p, fs = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        if overwrite and fs.exists(p):
            fs.delete(p, False)
        if fs.exists(p) or not fs.rename(beside, p):
            fs.delete(beside, False)
            raise FileExistsError(path)

    def read_json(self, path: str) -> Any:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
