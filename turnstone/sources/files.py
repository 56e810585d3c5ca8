"""Small files beside the data: pointers, markers and states that appear whole or not at all."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of Spark's file systems.

    Files are written beside and renamed to a name that does not exist yet, so
    a reader or a crash never meets half a file, whatever rename does to
    existing targets. What changes is numbered: the highest number counts.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = ""):  # noqa: ANN201
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self.path(name))] if self.exists(name) else []

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        f = self._fs.open(self.path(name))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def create(self, name: str, body: str) -> bool:
        """Writes a new file; False, and nothing changed, if one of that name is there."""
        new = self.path(f".{name.replace('/', '-')}.{uuid.uuid4().hex}")
        f = self._fs.create(new, True)
        try:
            f.write(bytearray(body.encode()))
        finally:
            f.close()
        self._fs.mkdirs(self.path(name).getParent())
        if not self.exists(name) and self._fs.rename(new, self.path(name)):
            return True
        self._fs.delete(new, False)
        return False

    def delete(self, name: str = "") -> None:
        self._fs.delete(self.path(name), True)

    def numbers(self, name: str) -> list[int]:
        found = (re.fullmatch(re.escape(name) + r"-(\d+)", x) for x in self.names())
        return sorted(int(m[1]) for m in found if m)

    def latest(self, name: str) -> str | None:
        """The body of the numbered file ``name`` with the highest number."""
        n = self.numbers(name)
        return self.read(f"{name}-{n[-1]:012d}") if n else None

    def advance(self, name: str, body: str) -> None:
        """A new highest number; a few older ones stay. Two writers at a time: one of them fails."""
        n = self.numbers(name)
        if not self.create(f"{name}-{(n[-1] + 1 if n else 1):012d}", body):
            raise RuntimeError(f"another writer has changed {name} below {self.root}")
        for old in n[: -self.KEPT + 1]:
            self.delete(f"{name}-{old:012d}")
