"""Bytes of files wherever they are: local, over HTTP, or in a store that Arrow's file systems reach."""

from __future__ import annotations

import functools
import os
import re
from urllib.error import HTTPError
from urllib.parse import unquote, urlsplit
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession

from tissuelake.functions.identity import join_path

#: Seconds that a request may take, and how often one is tried.
TIMEOUT, TRIES = 60, 3


def _scheme(uri: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", uri)
    return found[1].lower() if found else ""


def _local(uri: str) -> str:
    return unquote(urlsplit(uri).path) if _scheme(uri) == "file" else uri


@functools.lru_cache(maxsize=64)
def _system(root: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root)[0]


def _http(uri: str, span: str | None) -> bytes | None:
    for k in range(1, TRIES + 1):
        try:
            with urlopen(Request(uri, headers={"Range": f"bytes={span}"} if span else {}), timeout=TIMEOUT) as answer:
                return answer.read()
        except OSError as e:
            code = e.code if isinstance(e, HTTPError) else 503
            if code in (404, 410):
                return None
            if k == TRIES or (code < 500 and code != 429):
                raise
    return None


def read_bytes(uri: str, start: int = 0, length: int | None = None) -> bytes | None:
    """A file's bytes, or some of them (a negative start counts from its end); None if there is no such file.

    Credentials of an HTTP store are part of the URI's query, which child() carries to every file.
    """
    scheme = _scheme(uri)
    if scheme in ("http", "https"):
        whole = not start and length is None
        return _http(uri, None if whole else str(start) if start < 0 else f"{start}-{'' if length is None else start + length - 1}")
    try:
        if scheme in ("", "file"):
            with open(_local(uri), "rb") as f:
                if start:
                    f.seek(start, os.SEEK_END if start < 0 else os.SEEK_SET)
                return f.read(-1 if length is None else length)
        parts = urlsplit(uri)
        name = uri.partition("://")[2].partition("?")[0] if scheme not in ("hdfs", "viewfs") else parts.path
        with _system(f"{scheme}://{parts.netloc}/").open_input_file(name) as f:
            if start:
                f.seek(start if start > 0 else f.size() + start)
            return f.read() if length is None else f.read(length)
    except (FileNotFoundError, NotADirectoryError):
        return None


def child(uri: str, *names: str) -> str:
    """A file below a store's URI; its query stays at the end."""
    return join_path(uri, *names)


def stores_below(spark: SparkSession, folder: str) -> list[str]:
    """The *.zarr stores directly in a folder of any file system that Spark reads, in byte order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.zarr")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = [s.getPath().toString() for s in found or []]
    return sorted((n.removeprefix("file:") if n.startswith("file:/") and not folder.startswith("file:") else n for n in names), key=str.encode)
