"""Names and small texts in any store that Spark reaches; rows go through Spark's own readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        context = spark.sparkContext
        self._fs = context._jvm.org.apache.hadoop.fs
        self._conf = context._jsc.hadoopConfiguration()
        self._files = self._fs.Path(root).getFileSystem(self._conf)
        kind = getattr(context._jvm, "org.apache.hadoop.fs.Options$Rename")
        self._no_overwrite = context._gateway.new_array(kind, 1)
        self._no_overwrite[0] = kind.NONE

    def names(self, folder: str) -> list[str]:
        """What stands in a folder, ascending, drafts left out; nothing if it is missing."""
        path = self._fs.Path(folder)
        found = [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []
        return sorted(n for n in found if not n.startswith("."))

    def exists(self, path: str) -> bool:
        return self._files.exists(self._fs.Path(path))

    def read(self, path: str) -> str:
        stream = self._files.open(self._fs.Path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a file that must not exist: it appears whole, by a rename; an error if another one came first."""
        folder, name = path.rsplit("/", 1)
        self._files.mkdirs(self._fs.Path(folder))
        draft = self._fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
        stream = self._files.create(draft, True)
        stream.write(text.encode())
        stream.close()
        self._fs.FileContext.getFileContext(self._files.getUri(), self._conf).rename(draft, self._fs.Path(path), self._no_overwrite)

    def delete(self, path: str) -> None:
        self._files.delete(self._fs.Path(path), True)
