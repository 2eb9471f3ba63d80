"""A vault's changes as a stream: a data source whose offsets are listings, and whose rows are what differs between two of them.

`spark.readStream.format("vault_changes")` lists the folder whenever Spark asks for the newest offset. A listing that differs from the
last one is written below `state` in buckets by path, and its number is the offset; so a batch that is read again, after a failure or a
restart, compares the same two listings. Folders stand for the files in them: a moved or deleted folder is its files' events.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, kind string, ts timestamp, event_id long, moved_from string"
BUCKETS = 8
CREATED, MODIFIED, DELETED, MOVED = "create", "modify", "delete", "move"


class Bucket(InputPartition):
    def __init__(self, before: int, after: int, bucket: int):
        super().__init__((before, after, bucket))
        self.before, self.after, self.bucket = before, after, bucket


def bucket_of(path: str) -> int:
    return zlib.crc32(path.encode()) % BUCKETS


class Listings:
    """Listings of a folder, by number; number 0 is the empty one before the first."""

    def __init__(self, path: str, state: str, pattern: str):
        self.path, self.state, self.pattern = path, state, pattern

    @staticmethod
    def _at(place: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(place if "://" in place or place.startswith("file:") else f"file://{place}")

    def now(self) -> dict[str, list] | None:
        """Path to (size, nanoseconds of its last change) of the files there are; None where the folder can't be listed."""
        system, root = self._at(self.path)
        try:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
        except (FileNotFoundError, OSError):
            return None
        out = {}
        for x in found:
            name = x.path[len(root.rstrip("/")) + 1 :]
            if x.type == fs.FileType.File and fnmatch(name.rpartition("/")[2], self.pattern) and not any(p.startswith(".") for p in name.split("/")):
                out[name] = [x.size, x.mtime_ns]
        return out

    def last(self) -> int:
        """The number of the last listing that was written whole."""
        system, root = self._at(self.state)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return max((int(x.base_name.removesuffix(".done")) for x in found if x.base_name.endswith(".done")), default=0)

    def read(self, number: int, bucket: int) -> dict[str, list]:
        if not number:
            return {}
        system, root = self._at(self.state)
        with system.open_input_stream(f"{root}/{number}-{bucket}.json") as f:
            return json.loads(f.read())

    def write(self, number: int, files: dict[str, list]) -> None:
        system, root = self._at(self.state)
        system.create_dir(root, recursive=True)
        parts: list[dict] = [{} for _ in range(BUCKETS)]
        for path, mark in files.items():
            parts[bucket_of(path)][path] = mark
        for k, part in enumerate(parts):
            with system.open_output_stream(f"{root}/{number}-{k}.json") as f:
                f.write(json.dumps(part).encode())
        with system.open_output_stream(f"{root}/{number}.done") as f:
            f.write(b"")

    def forget(self, before: int) -> None:
        """Removes the listings that no batch asks for any more."""
        system, root = self._at(self.state)
        for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            number = x.base_name.partition("-")[0].removesuffix(".done")
            if number.isdigit() and int(number) < before:
                system.delete_file(x.path)


class Changes(DataSourceStreamReader):
    def __init__(self, options):
        self.listings = Listings(options["path"], options["state"], options.get("pattern", "*.md"))
        self.seen: dict[str, list] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """A new listing where files differ. A folder that can't be listed, or is empty after it wasn't, counts as away: nothing goes."""
        number = self.listings.last()
        if self.seen is None:
            self.seen = {p: m for k in range(BUCKETS) for p, m in self.listings.read(number, k).items()}
        files = self.listings.now()
        if files is not None and files != self.seen and (files or not self.seen):
            number += 1
            self.listings.write(number, files)
            self.seen = files
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Bucket(start["listing"], end["listing"], k) for k in range(BUCKETS)]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        before, after = (self.listings.read(n, partition.bucket) for n in (partition.before, partition.after))
        rows = []
        left: dict[tuple, list[str]] = {}
        if partition.before:
            # a file of the same size and time that left, in any bucket, is where a new one came from
            for k in range(BUCKETS):
                old, new = self.listings.read(partition.before, k), self.listings.read(partition.after, k)
                for path in sorted(old.keys() - new.keys()):
                    left.setdefault(tuple(old[path]), []).append(path)
        for path in sorted(before.keys() | after.keys()):
            was, now = before.get(path), after.get(path)
            if was == now:
                continue
            source = None
            if now is None:
                kind = DELETED
            elif was is None:
                source = next(iter(left.get(tuple(now), [])), None) if len(left.get(tuple(now), [])) == 1 else None
                kind = MOVED if source else CREATED
            else:
                kind = MODIFIED
            at = (now or was)[1] // 1000 if now is not None else None
            rows.append((path, kind, at, partition.after, source))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "kind", "ts", "event_id", "moved_from"])

    def commit(self, end: dict) -> None:
        self.listings.forget(end["listing"] - 1)


class VaultChanges(DataSource):
    """Options: path (the folder), state (a folder of the stream's own, that lives as long as its checkpoint), pattern (*.md)."""

    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Changes:  # noqa: N802
        return Changes(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known: rows (path, kind, ts, event_id, moved_from). kind: create, modify, delete, and move for a file that left
    another path with the same size and time; that path's own row is a delete, so who doesn't care for moves sees a new and a gone file.
    ts is the file's last change, null for a delete; event_id grows with each listing. Hidden files and folders are left out."""
    spark.dataSource.register(VaultChanges)
