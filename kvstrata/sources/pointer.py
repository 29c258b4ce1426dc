"""Atomic publication of small documents by rename, on any Hadoop file system."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Pointer:
    """A JSON file that is replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._at = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(self._conf)

    def read(self) -> dict | None:
        """The document last published, or None."""
        if not self._fs.exists(self._at):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(self.path).collect()))

    def publish(self, document: dict) -> None:
        """Write beside the file, then rename over it."""
        draft = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}.next")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        rename = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, self._at, how)
