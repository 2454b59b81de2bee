"""Streaming sources for folders that others write to: a spool of lines that grows, and files that have come to rest.

Both are Python data sources: spark.dataSource.register(SpoolSource), then spark.readStream.format("spool"). Folders are
reached through Arrow's file systems, by URI, so that they may lie in an object store; the driver lists them and reads
line ends, executors read the lines.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that tell a file from another of the same name, and bytes read at a time in search of a line's end.
HEAD, STEP = 64, 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it; Hadoop's file: URIs have one slash."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":/" in path else (fs.LocalFileSystem(), path)


def listed(path: str, recursive: bool = False) -> list[fs.FileInfo]:
    files, root = opened(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=recursive, allow_not_found=True))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def last_line_end(file: pa.NativeFile, start: int, limit: int, size: int) -> int:
    """Where the last whole line ends that begins at start or later and ends by limit; a first line that is longer than that
    is taken whole. start: no line has ended."""
    at = limit
    while at > start:
        low = max(start, at - STEP)
        file.seek(low)
        k = file.read(at - low).rfind(b"\n")
        if k >= 0:
            return low + k + 1
        at = low
    at = limit
    while at < size:
        file.seek(at)
        block = file.read(min(STEP, size - at))
        k = block.find(b"\n")
        if k >= 0:
            return at + k + 1
        at += len(block)
    return start


@dataclass
class Range(InputPartition):
    """Whole lines of a file from one byte to another that begin at first or later and before last."""

    path: str
    start: int
    first: int
    last: int


class SpoolReader(DataSourceStreamReader):
    """The offset says of each file how many bytes are read, and a digest of its first bytes. A file that was replaced or
    cut off is read from its beginning. A line without an end waits for the rest of it."""

    def __init__(self, path: str, budget: int):
        self.path, self.budget = path, budget
        self.base: dict | None = None

    def initialOffset(self) -> dict:
        self.base = {}
        return {}

    def latestOffset(self) -> dict:
        """What is there by now: at most budget bytes of lines beyond the offset before (and one line, if it is longer). A
        stream that is started again has no offset before to count from; its first batch takes all there is."""
        files, _ = opened(self.path)
        room = None if self.base is None else self.budget
        base, offset = self.base or {}, {}
        for f in listed(self.path):
            with files.open_input_file(f.path) as file:
                size = file.size()
                head = hashlib.sha256(file.read(min(HEAD, size))).hexdigest()[:16]
                was = base.get(f.path)
                start = was["end"] if was and same_file(file, was, size) else 0
                end = start
                if size > start and (room is None or room > 0):
                    end = last_line_end(file, start, size if room is None else min(size, start + room), size)
                    room = None if room is None else room - (end - start)
                if end > 0 or was:
                    offset[f.path] = {"end": end, "head": head, "known": min(HEAD, size)}
        self.base = offset
        return offset

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files, _ = opened(self.path)
        out = []
        for path, to in end.items():
            was, begin = start.get(path), 0
            if was and was["end"] <= to["end"]:
                with files.open_input_file(path) as file:
                    begin = was["end"] if same_file(file, was, file.size()) else 0
            for first in range(begin, to["end"], self.budget):
                out.append(Range(path, begin, first, min(first + self.budget, to["end"])))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        """path, at, value of the lines that begin in the range; bytes that are no text become U+FFFD."""
        files, _ = opened(self.path)
        with files.open_input_file(partition.path) as file:
            skipping = partition.first > partition.start  # the rest of a line that the range before has
            at = partition.first - skipping
            file.seek(at)
            held = b""
            while at < partition.last:
                k = held.find(b"\n")
                while k < 0:
                    block = file.read(STEP)
                    if not block:
                        return
                    held += block
                    k = held.find(b"\n", len(held) - len(block))
                line, held = held[:k], held[k + 1 :]
                if not skipping:
                    yield partition.path, at, line.decode("utf-8", "replace")
                skipping = False
                at += k + 1

    def commit(self, end: dict) -> None:
        pass


def same_file(file: pa.NativeFile, was: dict, size: int) -> bool:
    """Whether a file still begins as it did, and is as long at least."""
    if size < was["end"]:
        return False
    file.seek(0)
    return hashlib.sha256(file.read(was["known"])).hexdigest()[:16] == was["head"]


class SpoolSource(DataSource):
    """Lines (path, at, value) of the files of a folder, as they are appended. Options: path; maxBytes, of a batch and of a
    task."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return "path string, at bigint, value string"

    def streamReader(self, schema) -> SpoolReader:
        return SpoolReader(self.options["path"], int(self.options.get("maxBytes", 8 << 20)))


@dataclass
class Some(InputPartition):
    """Files between two offsets."""

    rows: list


class SettledReader(DataSourceStreamReader):
    """The offset is the time and name of the last file that was given, in order of time of change, so that it stays as
    small as it is. A file that changes comes again, with another fingerprint. A file that is put there with a time in the
    past is only seen if nothing later was given before."""

    def __init__(self, path: str, suffixes: tuple[str, ...], settle: float, recursive: bool):
        self.path, self.suffixes, self.settle, self.recursive = path, suffixes, settle, recursive

    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def settled(self) -> list[tuple[int, str, int]]:
        """(time in nanoseconds, path, size) of files with a suffix that have not changed for so long."""
        before = time.time_ns() - int(self.settle * 1e9)
        found = [(f.mtime_ns, f.path, f.size) for f in listed(self.path, self.recursive) if f.path.lower().endswith(self.suffixes)]
        return sorted(x for x in found if x[0] <= before)

    def latestOffset(self) -> dict:
        files = self.settled()
        return {"at": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Some]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        rows = [x for x in self.settled() if low < x[:2] <= high]
        return [Some(rows[i : i + 1000]) for i in range(0, len(rows), 1000)]

    def read(self, partition: Some) -> Iterator[tuple]:
        for at, path, size in partition.rows:
            changed = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=at // 1000)
            yield path, changed, size, hashlib.sha256(f"{path}|{size}|{at}".encode()).hexdigest()[:16]

    def commit(self, end: dict) -> None:
        pass


class SettledSource(DataSource):
    """Files (path, modified, size, fingerprint) of a folder that have come to rest. Options: path, suffixes (by comma),
    settleSeconds, recursive."""

    @classmethod
    def name(cls) -> str:
        return "settled"

    def schema(self) -> str:
        return "path string, modified timestamp, size bigint, fingerprint string"

    def streamReader(self, schema) -> SettledReader:
        suffixes = tuple(s.strip().lower() for s in self.options.get("suffixes", "").split(",") if s.strip()) or ("",)
        return SettledReader(self.options["path"], suffixes, float(self.options.get("settleSeconds", 60)), self.options.get("recursive", "true").lower() == "true")
