"""A sink of whole files that publishes all of a job's or none: data source `document_files`.

Tasks write their rows to files in a staging folder of the job. When all have, the driver notes what is to be moved where, moves it,
and takes the note away; a job that fails leaves nothing. A driver that is lost between leaves the note: recover(), which the next
job calls too, moves the rest. A task that ran twice, or was lost, has files that nobody moves.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = ".staging-"
NOTE = "moves.json"


def _store(folder: str):
    """File system and path of a folder: a path, or an address that pyarrow's file systems know."""
    from pyarrow import fs

    if re.match("[A-Za-z][A-Za-z0-9+.-]+:", folder):
        store, base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
    else:
        store, base = fs.LocalFileSystem(), folder
    return store, base.rstrip("/")


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def _move(store, source: str, target: str) -> None:
    if store.type_name != "local" and _there(store, target):
        store.delete_file(target)
    store.move(source, target)


def _finish(store, base: str, staging: str, moves: list[list[str]]) -> None:
    """Moves what hasn't been moved yet; then nothing of the job is left but its files."""
    for staged, name in moves:
        if _there(store, f"{staging}/{staged}"):
            _move(store, f"{staging}/{staged}", f"{base}/{name}")
    store.delete_dir(staging)


def recover(folder: str) -> int:
    """Finishes jobs that had begun to publish when their driver was lost; their number. Those that hadn't stay unpublished."""
    from pyarrow import fs

    store, base = _store(folder)
    done = 0
    if not _there(store, base):
        return done
    for info in store.get_file_info(fs.FileSelector(base)):
        note = f"{info.path}/{NOTE}"
        if info.base_name.startswith(STAGING) and _there(store, note):
            with store.open_input_stream(note) as source:
                moves = json.loads(source.read())
            _finish(store, base, info.path, moves)
            done += 1
    return done


@dataclass
class _Staged(WriterCommitMessage):
    #: Name in the staging folder, name to publish under.
    files: list[list[str]]


class _Publisher(DataSourceWriter):
    def __init__(self, folder: str, replace: bool):
        self.folder, self.replace, self.job = folder, replace, f"{STAGING}{uuid.uuid4().hex}"
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        recover(folder)

    def write(self, iterator: Iterator) -> _Staged:
        """In a task: each row's content to a file of the staging folder."""
        store, base = _store(self.folder)
        attempt, files = uuid.uuid4().hex, []
        store.create_dir(f"{base}/{self.job}", recursive=True)
        for k, (name, content) in enumerate(iterator):
            if not name or name.startswith(".") or "/" in name or "\\" in name:
                raise ValueError(f"not a file name: {name!r}")
            staged = f"{attempt}-{k}"
            with store.open_output_stream(f"{base}/{self.job}/{staged}") as out:
                out.write(bytes(content or b""))
            files.append([staged, name])
        return _Staged(files)

    def commit(self, messages: list[_Staged | None]) -> None:
        store, base = _store(self.folder)
        staging = f"{base}/{self.job}"
        moves = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in moves]
        if len(set(names)) < len(names):
            raise ValueError("two rows have one file name")
        if not self.replace and (taken := [n for n in names if _there(store, f"{base}/{n}")]):
            raise ValueError(f"there are files already, such as {taken[0]!r}")
        if not moves:
            if _there(store, staging):
                store.delete_dir(staging)
            return
        # once this note is there whole, the job counts as published
        with store.open_output_stream(f"{staging}/{NOTE}.part") as out:
            out.write(json.dumps(moves).encode())
        store.move(f"{staging}/{NOTE}.part", f"{staging}/{NOTE}")
        _finish(store, base, staging, moves)

    def abort(self, messages: list[_Staged | None]) -> None:
        store, base = _store(self.folder)
        staging = f"{base}/{self.job}"
        if _there(store, staging) and not _there(store, f"{staging}/{NOTE}"):
            store.delete_dir(staging)


class DocumentFiles(DataSource):
    """Writes rows (name, content) as whole files to the folder `path`. Option replace: true to write over files that are there."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _Publisher:
        if [f.name for f in schema] != ["name", "content"]:
            raise ValueError("columns must be name and content")
        return _Publisher(self.options["path"], self.options.get("replace", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)


def publish(files: DataFrame, folder: str, name: str = "out_name", content: str = "content", replace: bool = False) -> None:
    """Writes all files of a table to a folder that all executors share, or none.

    A name that is null, empty, hidden or has a slash, one that two rows have, and without replace one that is there already are
    errors. A null content is an empty file. What a job publishes counts from the moment its note is written; a reader that
    comes while files are moved may see a part of them.
    """
    register(files.sparkSession)
    files.selectExpr(f"cast(`{name}` as string) as name", f"cast(`{content}` as binary) as content").write.format("document_files").option("path", folder).option("replace", str(replace).lower()).mode("append").save()
