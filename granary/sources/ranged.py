"""Bytes of archives by ranges: of contents that are held, or of files that are read where they lie, without the rest of them."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Held:
    """Content in memory."""

    def __init__(self, content: bytes):
        self.content, self.size, self.read_bytes = content, len(content), 0

    def read(self, at: int, n: int) -> bytes:
        self.read_bytes += max(0, min(n, self.size - at))
        return self.content[at : at + n]

    def close(self) -> None:
        pass


class File:
    """A file by its URI, opened on the worker: seeks to a range and reads it."""

    def __init__(self, uri: str):
        if uri.startswith("file:"):
            system, path = fs.LocalFileSystem(), "/" + unquote(uri[5:]).lstrip("/")
        elif "://" in uri:
            system, path = fs.FileSystem.from_uri(uri)
        else:
            system, path = fs.LocalFileSystem(), uri
        self.file = system.open_input_file(path)
        self.size, self.read_bytes = self.file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        got = self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""
        self.read_bytes += len(got)
        return got

    def close(self) -> None:
        self.file.close()


def sources(batch: pa.RecordBatch):
    """(archive_key, source) of each row of a batch that has content or physical_path as its second column; an OSError instead of a
    source that can't be opened."""
    for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
        try:
            s = File(x.as_py()) if pa.types.is_string(batch.column(1).type) else Held(x.as_py())
        except OSError as e:
            yield key, e
            continue
        yield key, s
        s.close()


def located(archives: DataFrame, *more: str) -> DataFrame:
    """archive_key and where its bytes are: content if archives have it, otherwise physical_path."""
    return archives.select("archive_key", F.col("content" if "content" in archives.columns else "physical_path").alias("located"), *more)
