"""Files in the shared folder that tasks write whole and other tasks map into memory."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import SparkSession


class Files:
    """A folder that all can reach. Where it is a mounted one, files are mapped in place; else a worker maps its copy."""

    def __init__(self, uri: str):
        self.uri = uri

    def _open(self):
        return pyarrow.fs.FileSystem.from_uri(self.uri)

    def put(self, name: str, data: bytes) -> None:
        """Whole or not at all, so tasks can run again."""
        fs, path = self._open()
        fs.create_dir(path, recursive=True)
        tmp = f"{path}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(tmp) as f:
            f.write(data)
        fs.move(tmp, f"{path}/{name}")

    def has(self, name: str) -> bool:
        fs, path = self._open()
        return fs.get_file_info(f"{path}/{name}").type == pyarrow.fs.FileType.File

    def map(self, name: str) -> memoryview:
        fs, path = self._open()
        where = f"{path}/{name}"
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):
            copy = os.path.join(tempfile.gettempdir(), uuid.uuid4().hex)
            pyarrow.fs.copy_files(where, copy, source_filesystem=fs, destination_filesystem=pyarrow.fs.LocalFileSystem())
            where = copy
        with open(where, "rb") as f:
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):
            os.unlink(where)  # the mapping stays
        return memoryview(m)


def qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
