"""Source trees on a mounted file system as a Spark data source that follows no links.

``spark.dataSource.register(TreeSource)`` once, then ``spark.read.format("source_tree").load(root)``. Folders down to a level are partitions, so many tasks
list and read; each entry is looked at without following it, and what a scan leaves out by size is never opened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import MAX_FILE_BYTES, PROBE

#: Bytes of content in a batch of rows.
BATCH_BYTES = 4 << 20


class Folder(InputPartition):
    """A folder by its path, and whether the folders in it belong to the same partition."""

    def __init__(self, path: str, below: bool):
        self.path, self.below = path, below


class TreeSource(DataSource):
    """scan_id (the first ``depth`` folders), path, size, content (null if the first bytes hold a zero). Options: ``depth`` (1), ``levels`` (2: folders so deep are dealt to tasks), ``maxBytes``.

    Links to files and folders are left out, loops therefore too; so are files above ``maxBytes`` and what is no regular file. Bytes that are no UTF-8 become U+FFFD.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "scan_id string, path string, size long, content string"

    def reader(self, schema) -> TreeReader:
        o = self.options
        return TreeReader(o["path"].removeprefix("file://"), int(o.get("depth", 1)), int(o.get("levels", 2)), int(o.get("maxBytes", MAX_FILE_BYTES)))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, depth: int, levels: int, most: int):
        self.root, self.depth, self.levels, self.most = root.rstrip("/") or "/", depth, levels, most

    def partitions(self) -> list[Folder]:
        level, out = [self.root], []
        for _ in range(self.levels):
            out += [Folder(p, False) for p in level]
            level = [e.path for p in level for e in _entries(p) if e.is_dir(follow_symlinks=False)]
        return out + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, size in self._files(partition):
            data = _bytes(path)
            parts = os.path.relpath(path, self.root).split(os.sep)
            rows.append(("/".join(parts[: self.depth]), "/".join(parts[self.depth :]), size, None if b"\0" in data[:PROBE] else data.decode("utf-8", "replace")))
            held += size
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _files(self, folder: Folder) -> Iterator[tuple[str, int]]:
        waiting = [folder.path]
        while waiting:
            for e in _entries(waiting.pop()):
                if e.is_dir(follow_symlinks=False):
                    if folder.below:
                        waiting.append(e.path)
                elif e.is_file(follow_symlinks=False) and (size := e.stat(follow_symlinks=False).st_size) <= self.most:
                    yield e.path, size


def _entries(path: str) -> list[os.DirEntry]:
    with os.scandir(path) as found:
        return sorted(found, key=lambda e: e.name)


def _bytes(path: str) -> bytes:
    """A file's bytes; one that has become a link since it was listed is an error."""
    with os.fdopen(os.open(path, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
        return f.read()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("scan_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
