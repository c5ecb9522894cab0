"""Small files in the shared folder, and a pointer that only moves forward.

A pointer is a folder of numbered files; the one with the highest number holds.
A number is taken by creating its file, which fails if another writer has it:
so of two writers that saw the same number one must look again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    number: int
    content: dict


class Folder:
    """A folder in the file system that its path, or the session's default, names."""

    def __init__(self, spark: SparkSession, path: str):
        self._new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self.path = path
        self._root = self._new(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self._fs.exists(self._root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._root))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._new(self.path, name))

    def drop(self) -> None:
        self._fs.delete(self._root, True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._new(self.path, name))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; false if the name is taken."""
        target = self._new(self.path, name)
        try:
            stream = self._fs.create(target, False)
        except Py4JJavaError:
            if self._fs.exists(target):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True


def latest(spark: SparkSession, path: str) -> Entry | None:
    """The entry that holds. A file that its writer never finished does not count."""
    folder = Folder(spark, path)
    for name in reversed(folder.names()):
        text = folder.read(name)
        if text.endswith("\n"):
            return Entry(int(name), json.loads(text))
    return None


ANY = Entry(0, {})


def move(spark: SparkSession, path: str, content: dict, expected: Entry | None = ANY) -> Entry | None:
    """Make ``content`` the entry that holds.

    With ``expected``, only if that one still holds (None: if there is none yet); the
    result None says that another writer came first.
    """
    folder = Folder(spark, path)
    text = json.dumps(content, ensure_ascii=False, sort_keys=True) + "\n"
    while True:
        taken = folder.names()
        number = int(taken[-1]) + 1 if taken else 1
        if expected is not ANY and latest(spark, path) != expected:
            return None
        if folder.create(f"{number:012d}", text):
            return Entry(number, content)
