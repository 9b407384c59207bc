"""Versions of a table as files that each name what belongs to it.

Publishing creates ``<version>.json`` under a name that must not exist, so of
two writers that saw the same version one fails.  That needs a file system
where creating without overwriting is atomic (HDFS, local and network disks); on
an object store without such a call only one writer at a time may commit.  A
file that a crash left unfinished can't be read and counts as never published.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession


class Manifests:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """What a folder holds; nothing if there is no such folder."""
        where = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def files(self, folder: str) -> list[tuple[str, int]]:
        """Names and bytes of the files of a folder."""
        where = self._path(folder)
        return [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(where) if s.isFile()] if self._fs.exists(where) else []

    def expire(self, newest: int, keep: int, folder: str, named: Callable[[dict], Iterable[str]]) -> None:
        """Delete the versions before the last ``keep``, and what of ``folder`` none of the kept ones names.

        ``folder`` holds one folder a commit, which begins with its version;
        names are relative to the parent of ``folder``.  Folders of later
        versions may belong to a writer that hasn't published yet and stay.
        """
        numbers = self._numbers()
        kept = [m for n in numbers[:keep] if (m := self.read(n)) is not None]
        used = {f for m in kept for f in named(m)}
        above, _, own = folder.rpartition("/")

        def clear(path: str) -> None:
            if path in used:
                return
            if not any(f.startswith(f"{path}/") for f in used):
                self._fs.delete(self._path(f"{above}/{path}"), True)
                return
            for inner in self.names(f"{above}/{path}"):
                if not inner.startswith(("_", ".")):
                    clear(f"{path}/{inner}")

        for name in self.names(folder):
            if int(name.partition("-")[0]) <= newest:
                clear(f"{own}/{name}")
        for n in numbers[keep:]:
            self._fs.delete(self._path(f"{self.folder}/{n:010d}.json"), False)

    def _numbers(self) -> list[int]:
        return sorted((int(n.removesuffix(".json")) for n in self.names(self.folder) if n.endswith(".json") and n[0] != "."), reverse=True)

    def read(self, version: int) -> dict | None:
        """None if there is no such version, or it was never finished."""
        path = self._path(f"{self.folder}/{version:010d}.json")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """The newest finished version; 0 and None if there is none."""
        return next(((n, m) for n in self._numbers() if (m := self.read(n)) is not None), (0, None))

    def publish(self, after: int, content: dict) -> int:
        """Make ``content`` the version after ``after``; fails if another writer was first."""
        newest, _ = self.latest()
        if newest != after:
            raise RuntimeError(f"version {newest} was published meanwhile")
        version = max([after, *self._numbers()]) + 1
        stream = self._fs.create(self._path(f"{self.folder}/{version:010d}.json"), False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        return version


def fresh(name: str) -> str:
    """A folder name that no other attempt writes to."""
    return f"{name}-{uuid.uuid4().hex[:12]}"
