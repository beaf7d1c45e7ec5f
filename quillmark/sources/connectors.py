"""Swap points, connectors and output connectors (S8, S9, X1, X2, X3): named implementations, chosen by a setting.

A setting is a name that was registered, or `package.module:Class` for one outside this package."""

from __future__ import annotations

import hashlib
import importlib
import os
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmark.sources.files import write_ndjson


class Registry:
    """A point at which implementations are swapped."""

    def __init__(self, point: str):
        self.point, self.known = point, {}

    def register(self, name: str) -> Callable[[Any], Any]:
        def add(what: Any) -> Any:
            if name in self.known:
                raise ValueError(f"{self.point}: {name} is there already")
            self.known[name] = what
            return what

        return add

    def resolve(self, setting: str) -> Any:
        if setting in self.known:
            return self.known[setting]
        if ":" not in setting:
            raise KeyError(f"{self.point}: no {setting}; there are {', '.join(sorted(self.known))}")
        module, _, name = setting.partition(":")
        return getattr(importlib.import_module(module), name)


@dataclass(frozen=True)
class RemoteFile:
    remote_id: str
    name: str
    etag: str
    size: int


class Connector(Protocol):
    """What a listener needs of an inbox."""

    def list(self, folder: str) -> list[RemoteFile]: ...

    def download(self, file: RemoteFile) -> bytes: ...

    def move(self, file: RemoteFile, folder: str) -> RemoteFile: ...

    def write_note(self, folder: str, name: str, text: str) -> None: ...


CONNECTORS, OUTPUTS, READERS = Registry("connector"), Registry("output"), Registry("reader")


@CONNECTORS.register("local")
class LocalConnector:
    """Folders under a root that all nodes see."""

    def __init__(self, root: str):
        self.root = root

    def _path(self, folder: str, name: str = "") -> str:
        path = os.path.normpath(os.path.join(self.root, folder, name))
        if os.path.commonpath([path, os.path.normpath(self.root)]) != os.path.normpath(self.root):
            raise ValueError(f"{folder}/{name} is outside of {self.root}")
        return path

    def list(self, folder: str) -> list[RemoteFile]:
        out = []
        if os.path.isdir(self._path(folder)):
            for e in sorted(os.scandir(self._path(folder)), key=lambda e: e.name):
                if e.is_file():
                    s = e.stat()
                    out.append(RemoteFile(f"{folder}/{e.name}", e.name, f"{s.st_size}-{s.st_mtime_ns}", s.st_size))
        return out

    def download(self, file: RemoteFile) -> bytes:
        with open(self._path(*file.remote_id.rsplit("/", 1)), "rb") as f:
            return f.read()

    def move(self, file: RemoteFile, folder: str) -> RemoteFile:
        os.makedirs(self._path(folder), exist_ok=True)
        shutil.move(self._path(*file.remote_id.rsplit("/", 1)), self._path(folder, file.name))
        return RemoteFile(f"{folder}/{file.name}", file.name, file.etag, file.size)

    def write_note(self, folder: str, name: str, text: str) -> None:
        """The note is there whole or not at all."""
        os.makedirs(self._path(folder), exist_ok=True)
        path = self._path(folder, name)
        with open(f"{path}.part", "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}.part", path)


@OUTPUTS.register("ndjson")
def ndjson(df: DataFrame, path: str) -> None:
    """An output connector is a function of rows and a path under a name."""
    write_ndjson(df, path)


@OUTPUTS.register("parquet")
def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


class Page(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class InboxReader(DataSourceReader):
    """Each folder is a partition, listed where it is read."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Page(f) for f in self.options.get("folders", "inbox").split(",")]

    def read(self, partition: Page) -> Iterator[tuple]:
        conn = CONNECTORS.resolve(self.options.get("connector", "local"))(self.options["root"])
        for f in conn.list(partition.folder):
            yield partition.folder, f.name, f.etag, f.size


class Inbox(DataSource):
    """Spark.read.format("inbox") with options connector, root and folders: the files that a connector lists."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        return "folder string, name string, etag string, size long"

    def reader(self, schema) -> DataSourceReader:
        return InboxReader(dict(self.options))


@READERS.register("stub")
def stub_reading(content: bytes) -> dict:
    """A reader that needs no model: the same content always gives the same reading."""
    digest = hashlib.sha256(content).hexdigest()
    return {"text": f"reading {digest[:8]}", "confidence": int(digest[8:12], 16) / 0xFFFF}
