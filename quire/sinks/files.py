"""Texts written to files of exactly their names and contents, by a data source whose files appear when all are written."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.python import ready

#: What stands at the start of a text file for programs that need to be told that it is UTF-8.
MARK = "﻿"
FORMAT = "named_texts"


@dataclass
class Written(WriterCommitMessage):
    staged: str
    names: list[str]


def checked(name: str) -> str:
    """A name below a folder: not empty, not absolute, and not leading out of it."""
    own = posixpath.normpath(name)
    if not name or own.startswith(("/", "..")) or own == "." or name.endswith("/"):
        raise ValueError(f"no name of a file: {name!r}")
    return own


class NamedTextWriter(DataSourceWriter):
    """Each task writes its texts to a folder of its own below `path`; the driver moves them to their names once all tasks
    are done. A task that is run again has another folder, so what a lost one left is never moved; it goes with the
    staging folder. Of a job that fails no file appears; what a task that still ran then staged after the folder was
    removed stays there. Of rows of one name the last moved stays."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.staging, self.overwrite = options["path"], f".staging-{uuid.uuid4().hex}", overwrite

    def store(self) -> tuple[fs.FileSystem, str]:
        """A local path, or a URI of a store that Arrow knows."""
        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + posixpath.abspath(self.path))
        return store, root.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        store, root = self.store()
        own, names = f"{self.staging}/{uuid.uuid4().hex}", []
        store.create_dir(f"{root}/{own}", recursive=True)
        for k, row in enumerate(iterator):
            with store.open_output_stream(f"{root}/{own}/{k}") as f:
                f.write((row[1] or "").encode("utf-8", "surrogatepass"))
            names.append(checked(row[0]))
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self.store()
        if self.overwrite:
            old = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name != self.staging]
            for f in old:
                store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path)
        folders = {posixpath.dirname(n) for m in messages if m for n in m.names}
        for folder in folders:
            store.create_dir(f"{root}/{folder}", recursive=True)
        for m in messages:
            for k, name in enumerate(m.names if m else []):
                store.move(f"{root}/{m.staged}/{k}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self.store())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class NamedTexts(DataSource):
    """Rows (name, text) as files: df.write.format("named_texts").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedTextWriter(dict(self.options), overwrite)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """(name, text) -> files of these names below path, with the texts in UTF-8 and nothing else. Folders in names are
    made. A null text is an empty file; a name that is none stops the job, and nothing appears. mode overwrite removes
    what stood in path before. path is a folder that all executors share, or a URI of a store."""
    ready(files.sparkSession)
    files.sparkSession.dataSource.register(NamedTexts)
    files.select("name", "text").write.format(FORMAT).mode(mode).save(path)
