"""A store of named result sections that a later attempt can go on with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class ResultStore:
    """Sections of one job in a folder, written one after the other.

    A section counts when its own job has written ``_SUCCESS``; whatever a
    failed attempt left of another is overwritten.  The folder belongs to the
    ``owner`` (the identity of the job's inputs) that opened it first; another
    owner is refused, so results of different inputs are never mixed."""

    def __init__(self, spark: SparkSession, folder: str, owner: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path
        self.path, self.fs = path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        mark = path(f"{folder}/owner/{owner}")
        held = path(f"{folder}/owner")
        if self.fs.exists(held) and not self.fs.exists(mark) and len(self.fs.listStatus(held)):
            raise ValueError("the folder belongs to another owner")
        self.fs.mkdirs(mark)

    def sections(self) -> list[str]:
        """Names of the finished sections."""
        p = self.path(f"{self.folder}/sections")
        if not self.fs.exists(p):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(p)]
        return sorted(n for n in names if self.fs.exists(self.path(f"{self.folder}/sections/{n}/_SUCCESS")))

    def section(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The section, made only if no attempt has finished it."""
        where = f"{self.folder}/sections/{name}"
        if name not in self.sections():
            make().write.mode("overwrite").parquet(where)
        return self.spark.read.parquet(where)
