"""A data source for npz files: a file for each stimulus and part, written so that all come into place or none does.

    spark.dataSource.register(NpzSource)
    spark.read.format("npz").option("path", folder).load()
    df.write.format("npz").option("path", folder).mode("append").save()

Tasks write into a staging folder beside the files; only when every task is done does the driver move the files into place, and a job
that fails deletes the folder. A task that is run again, or an executor that is lost, leaves nothing but what is in that folder.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: The array that a file has where no part says otherwise: its column, what follows the stimulus in the file's name, its name in the file.
PARTS = ({"column": "features", "suffix": "", "name": "features"},)
#: Rows of an array that are read into one batch.
ROWS = 10_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base_name(path: str) -> str:
    return posixpath.basename(path)[: -len(".npz")]


class NpzSource(DataSource):
    """Options: path; parts, a JSON list like PARTS; ignore and search, JSON lists of strings that a name must not have, or one of which it must have."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "stim string, frame long, features array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], json.loads(self.options.get("ignore", "[]")), json.loads(self.options.get("search", "[]")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], json.loads(self.options.get("parts", json.dumps(PARTS))), overwrite)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    """A partition for each file."""

    def __init__(self, path: str, ignore: list[str], search: list[str]):
        self.path, self.ignore, self.search = path, ignore, search

    def partitions(self) -> list[InputPartition]:
        files, root = _opened(self.path)
        names = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.is_file and f.path.endswith(".npz"))
        kept = [n for n in names if not any(s in base_name(n) for s in self.ignore) and (not self.search or any(s in base_name(n) for s in self.search))]
        return [_File(n) for n in kept]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        with _opened(self.path)[0].open_input_stream(partition.path) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as held:
            m = held[held.files[0]]
        m = m.reshape(len(m), -1).astype(float) if m.ndim else m.reshape(1, 1).astype(float)
        for at in range(0, len(m), ROWS):
            x = np.ascontiguousarray(m[at : at + ROWS])
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([base_name(partition.path)] * len(x)), pa.array(at + np.arange(len(x))), arrays], names=["stim", "frame", "features"])


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    """Rows must come grouped by stimulus, in order of their frames: stim, and a column for each part. A task holds one stimulus."""

    def __init__(self, path: str, parts: list[dict], overwrite: bool):
        self.path, self.parts, self.overwrite = path, parts, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        files, root = _opened(self.path)
        context = TaskContext.get()
        folder = posixpath.join(root, self.staging, f"{context.partitionId()}-{context.taskAttemptId()}")
        files.create_dir(folder, recursive=True)
        names, stim, held = [], None, [[] for _ in self.parts]

        def save() -> None:
            for part, values in zip(self.parts, held):
                packed = io.BytesIO()
                np.savez_compressed(packed, **{part.get("name") or "arr_0": np.array(values)})
                names.append(f"{stim}{part['suffix']}.npz")
                with files.open_output_stream(posixpath.join(folder, names[-1])) as f:
                    f.write(packed.getvalue())
                values.clear()

        for row in rows:
            if held[0] and row["stim"] != stim:
                save()
            stim = row["stim"]
            for part, values in zip(self.parts, held):
                values.append(row[part["column"]])
        if held[0]:
            save()
        return _Written(folder, names)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _opened(self.path)
        names = [n for m in messages if m for n in m.names]
        twice = len(names) - len(set(names))
        if twice:
            self.abort(messages)
            raise ValueError(f"{twice} stimuli are in more than one task: deal the rows by stimulus")
        if self.overwrite:
            ends = tuple(f"{p['suffix']}.npz" for p in self.parts)
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.path.endswith(ends) and posixpath.basename(f.path) not in names:
                    files.delete_file(f.path)
        for m in messages:
            for n in m.names if m else ():
                files.move(posixpath.join(m.folder, n), posixpath.join(root, n))
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = _opened(self.path)
        at = posixpath.join(root, self.staging)
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)
