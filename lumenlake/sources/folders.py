"""Folders as a table: a Python data source whose tasks list the folders of their own subtrees.

    spark.dataSource.register(FolderSource)
    spark.read.format("folders").option("path", root).load()

Each folder below the root is a row without a file (the root too, and folders without media), each media file one more. The path
must be one that all executors see. Names that begin with a dot, ignored names (in any case), symbolic links, files of other
endings and empty files are left out; excluded folders with all that is below them. A folder with an entry that cannot be read
has no files and no signature: an incomplete listing must not look like a deletion. A missing root is such a folder.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenlake.operators.files import IMAGES, RAWS, VIDEOS

#: Subtrees that the driver looks for before it leaves the listing to tasks.
PARTS = 64
SCHEMA = "folder string, name string, parent string, readable boolean, signature string, files int, path string, file string, bytes bigint, modified timestamp"
_BATCH = 4096


@dataclass
class Subtree(InputPartition):
    """A folder relative to the root; deep: with all that is below it."""

    folder: str
    deep: bool


class FolderSource(DataSource):
    """Options: path; base (a folder below it at which to begin); ignored and excluded (parted by |); endings (parted by |, those of
    media if unset); children (false for one folder alone)."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return FolderReader(dict(self.options))


def signature(files: list[tuple[str, int, float]]) -> str:
    """A print of a listing: its length, and name, size and time of each file in order."""
    digest = hashlib.blake2b(f"{len(files)}\n".encode(), digest_size=16)
    for name, size, modified in sorted(files):
        digest.update(f"{name}\x1f{size}\x1f{modified}\n".encode())
    return digest.hexdigest()


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        several = lambda key: frozenset(filter(None, low.get(key, "").split("|")))
        self.root, self.base = low["path"], low.get("base", "").strip("/")
        self.ignored, self.excluded = frozenset(x.casefold() for x in several("ignored")), several("excluded")
        self.endings = frozenset(x.lower() for x in several("endings")) or frozenset({*IMAGES, *RAWS, *VIDEOS})
        self.children, self.parts = low.get("children", "true").lower() == "true", int(low.get("parts", PARTS))

    def listing(self, folder: str) -> tuple[list[tuple[str, int, float]] | None, list[str]]:
        """(name, size, time of the media files, None if it cannot be read; the folders below, sorted)."""
        files, below = [], []
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in entries:
                    if e.name.startswith(".") or e.name.casefold() in self.ignored or e.is_symlink():
                        continue
                    path = f"{folder}/{e.name}" if folder else e.name
                    if e.is_dir(follow_symlinks=False):
                        below += [path] if path not in self.excluded else []
                    elif os.path.splitext(e.name)[1][1:].lower() in self.endings:
                        stat = e.stat(follow_symlinks=False)
                        if stat.st_size:
                            files.append((e.name, stat.st_size, stat.st_mtime))
        except OSError:
            return None, []
        return sorted(files), sorted(below)

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough of them; those that were opened are listed by themselves."""
        opened, open_ = [], [self.base]
        while self.children and open_ and len(opened) + len(open_) < self.parts:
            below = [b for f in open_ for b in self.listing(f)[1]]
            opened, open_ = opened + open_, below
            if not below:
                break
        return [Subtree(f, False) for f in opened] + [Subtree(f, self.children) for f in open_]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        stack = [partition.folder]
        while stack:
            folder = stack.pop()
            files, below = self.listing(folder)
            parent, _, name = folder.rpartition("/")
            head = (folder, name or os.path.basename(os.path.normpath(self.root)), (parent if folder else None), files is not None)
            sign = None if files is None else signature(files)
            rows.append((*head, sign, None if files is None else len(files), None, None, None, None))
            for file, size, modified in files or ():
                rows.append((*head, sign, len(files), f"{folder}/{file}" if folder else file, file, size, dt.datetime.fromtimestamp(modified, dt.UTC)))
                if len(rows) >= _BATCH:
                    yield _batch(rows)
                    rows = []
            if partition.deep:
                stack += reversed(below)
        if rows:
            yield _batch(rows)


_KINDS = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)
