"""The few file operations that the commit protocol needs, on local paths or through Hadoop's file systems."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Callable
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


#: How paths of the local file system start.
LOCAL = ("/", "file:/")
#: Seconds for which an older version of a value stays, so that its number can't be taken again by a writer that read it.
KEPT = 60.0


class Files:
    """Small files under one root. `create` is exclusive: of two writers of one name, one gets FileExistsError."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        # Hadoop's rename overwrites on local paths, so these are used directly
        self.local = "/" + self.root.removeprefix("file:").lstrip("/") if self.root.startswith(LOCAL) else None
        if self.local is None:
            self._jvm = spark.sparkContext._jvm
            self._path = self._jvm.org.apache.hadoop.fs.Path
            self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        if self.local is not None:
            with suppress(FileNotFoundError):
                return sorted(n for n in os.listdir(f"{self.local}/{folder}") if n[0] not in "._")
            return []
        at = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(at):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(at)) if n[0] not in "._")

    def ensure(self, folder: str) -> None:
        if self.local is not None:
            os.makedirs(f"{self.local}/{folder}", exist_ok=True)
        else:
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def read(self, name: str) -> str | None:
        if self.local is not None:
            with suppress(FileNotFoundError), open(f"{self.local}/{name}", encoding="utf-8") as f:
                return f.read()
            return None
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_temporary(self, name: str, text: str) -> str:
        folder, _, base = name.rpartition("/")
        temporary = f"{folder}/.{base}.{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(f"{self.local}/{folder}", exist_ok=True)
            with open(f"{self.local}/{temporary}", "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
        else:
            stream = self._fs.create(self._path(f"{self.root}/{temporary}"), False)
            stream.write(bytearray(text.encode()))
            stream.close()
        return temporary

    def create(self, name: str, text: str) -> None:
        """Publishes a whole file under a new name in one step."""
        temporary = self._write_temporary(name, text)
        if self.local is not None:
            try:
                os.link(f"{self.local}/{temporary}", f"{self.local}/{name}")
            finally:
                os.unlink(f"{self.local}/{temporary}")
        else:
            source, target = (self._path(f"{self.root}/{n}") for n in (temporary, name))
            if self._fs.exists(target) or not self._fs.rename(source, target):
                self._fs.delete(source, False)
                raise FileExistsError(name)

    def delete(self, name: str) -> None:
        """Removes a file or a folder with all it holds; nothing happens if there is none."""
        if self.local is not None:
            path = f"{self.local}/{name}"
            if os.path.isdir(path):
                shutil.rmtree(path, ignore_errors=True)
            else:
                with suppress(FileNotFoundError):
                    os.unlink(path)
        else:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def age(self, name: str) -> float:
        """Seconds since the file or folder was changed; 0 if there is none."""
        if self.local is not None:
            with suppress(FileNotFoundError):
                return time.time() - os.stat(f"{self.local}/{name}").st_mtime
            return 0.0
        at = self._path(f"{self.root}/{name}")
        try:
            return time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000
        except Py4JJavaError:
            if self._fs.exists(at):
                raise
            return 0.0

    # small values that change: a folder of numbered files, the highest of which holds the value

    def value(self, name: str) -> tuple[int, str | None]:
        """The number and text of the value's newest version, (-1, None) if there is none."""
        while True:
            names = self.names(name)
            if not names:
                return -1, None
            text = self.read(f"{name}/{names[-1]}")
            if text is not None:  # else two newer ones have come since the names were read
                return int(names[-1]), text

    def update(self, name: str, change: Callable[[str | None], str | None]) -> str | None:
        """Sets the value to change(old value) and returns it, or the old one where that is None. Versions are created exclusively:
        no change is lost, and a reader always finds a whole version."""
        while True:
            started = time.monotonic()
            number, old = self.value(name)
            new = change(old)
            if new is None:
                return old
            if time.monotonic() - started > KEPT / 2:  # the next number may have been taken and removed since
                continue
            try:
                self.create(f"{name}/{number + 1:020d}", new)
            except FileExistsError:
                continue
            for n in self.names(name):
                if int(n) < number and self.age(f"{name}/{n}") > KEPT:
                    self.delete(f"{name}/{n}")
            return new
