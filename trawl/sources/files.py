"""Files of an index, through Spark's own file systems: any path that Spark can open works."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.conf)

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def complete(self, *parts: str) -> bool:
        return self.fs.exists(self._at(*parts, "_SUCCESS"))

    def sizes(self, *parts: str) -> list[tuple[str, int]]:
        """(name, bytes) of the data files of a written table."""
        at = self._at(*parts)
        if not self.fs.exists(at):
            return []
        return sorted((s.getPath().getName(), int(s.getLen())) for s in self.fs.listStatus(at) if s.isFile() and s.getPath().getName().startswith("part-"))

    def create(self, text: str, *parts: str) -> bool:
        """Writes a new small file whole; False if the name is taken."""
        target, part = self._at(*parts), self._at(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        if self.fs.exists(target):
            return False
        out = self.fs.create(part, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.fs.exists(target) or not self.fs.rename(part, target):
            self.fs.delete(part, False)
            return False
        return True

    def read_json(self, *parts: str) -> dict:
        stream = self.fs.open(self._at(*parts))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def delete(self, *parts: str) -> None:
        self.fs.delete(self._at(*parts), True)

    def move_away(self, *parts: str) -> None:
        """Removes a small file that others may be removing too: only one of them renames it."""
        gone = self._at(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        if self.fs.rename(self._at(*parts), gone):
            self.fs.delete(gone, False)
