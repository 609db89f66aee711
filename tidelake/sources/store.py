"""Small files by path, on any file system that Spark reads.

The commit log needs one primitive: create a file with its whole content, or
fail because it is there.  On local disks that is a hard link of a finished
temporary file; elsewhere Hadoop's create without overwrite, which is exclusive
on HDFS and on object stores with conditional writes.
"""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def local(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, path: str, data: bytes) -> bool:
        """False if the file is there already."""
        if is_local(path):
            at = Path(local(path))
            at.parent.mkdir(parents=True, exist_ok=True)
            temp = at.parent / f".{at.name}.{uuid.uuid4().hex}"
            temp.write_bytes(data)
            try:
                os.link(temp, at)
                return True
            except FileExistsError:
                return False
            finally:
                temp.unlink()
        p, fs = self._fs(path)
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Exception as e:  # py4j wraps FileAlreadyExistsException
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(data))
        out.close()
        return True

    def read(self, path: str) -> bytes | None:
        if is_local(path):
            at = Path(local(path))
            return at.read_bytes() if at.is_file() else None
        p, fs = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if is_local(folder):
            at = Path(local(folder))
            return sorted(x.name for x in at.iterdir() if not x.name.startswith(".")) if at.is_dir() else []
        p, fs = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def files(self, folder: str) -> list[tuple[str, int]]:
        """Paths and sizes of all files below a folder, in order."""
        if is_local(folder):
            return sorted((str(x), x.stat().st_size) for x in Path(local(folder)).rglob("*") if x.is_file() and not x.name.startswith((".", "_")))
        p, fs = self._fs(folder)
        out, found = [], fs.listFiles(p, True)
        while found.hasNext():
            s = found.next()
            if not s.getPath().getName().startswith((".", "_")):
                out.append((s.getPath().toString(), s.getLen()))
        return sorted(out)

    def move(self, path: str, to: str) -> None:
        """Rename a file; nothing may be at the new place."""
        if is_local(path):
            at = Path(local(to))
            at.parent.mkdir(parents=True, exist_ok=True)
            os.rename(local(path), at)
            return
        p, fs = self._fs(path)
        q, _ = self._fs(to)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"{path} could not be moved to {to}")

    def delete(self, path: str) -> None:
        if is_local(path):
            at = Path(local(path))
            if at.is_dir():
                shutil.rmtree(at)
            else:
                at.unlink(missing_ok=True)
            return
        p, fs = self._fs(path)
        fs.delete(p, True)


def read_bytes(path: str) -> bytes:
    """A whole file, on an executor."""
    if is_local(path):
        return Path(local(path)).read_bytes()
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    with files.open_input_stream(at) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    """A whole file, on an executor."""
    if is_local(path):
        at = Path(local(path))
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
        return
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    with files.open_output_stream(at) as f:
        f.write(data)
