"""Transcript files: a splittable batch scan and a tailing stream, both with byte offsets.

``spark.dataSource.register(TranscriptLines)``, then format("transcript_lines")
with option ``path`` (folder or file) and optionally ``recursive`` (default
true), ``split`` (bytes per task, default 64 MiB) and, for batches, ``start``
(byte offset to begin at, at the start of a line) and ``whole`` (leave out what
is behind the last line that is complete), for streams ``initial`` (JSON of
offsets by path at which a new stream begins). A last line without a line break
is complete if it is a JSON object; otherwise it is still being written and the
stream waits for the rest. A file that cannot be read gives one row with a null
line at the offset where reading ended, and does not stop the others.
Columns: path, session_id (file stem), byte_offset, line (without its line
break), breaks (bytes of the line break), next_offset (where the next line
begins). Offsets are true bytes, also for files with CR LF or invalid UTF-8.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, session_id string, byte_offset bigint, line string, breaks int, next_offset bigint"
SUFFIX = ".jsonl"


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int) -> None:
        self.path, self.start, self.end, self.first = path, start, end, first


def _fs(path: str):  # noqa: ANN202
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str, recursive: bool = True) -> dict[str, int]:
    """Sizes of the transcript files at a path; files that vanish meanwhile are passed over."""
    from pyarrow import fs

    system, root = _fs(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return {info.path: info.size}
    if info.type == fs.FileType.NotFound:
        return {}
    found = system.get_file_info(fs.FileSelector(root, recursive=recursive, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX)}


def _stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name[: -len(SUFFIX)] if name.endswith(SUFFIX) else name


def complete_end(system, path: str, size: int) -> int:  # noqa: ANN001
    """The end of the last complete line within the first ``size`` bytes of a file."""
    with system.open_input_file(path) as f:
        end, tail = size, b""
        while end > 0:
            start = max(0, end - (1 << 16))
            f.seek(start)
            block = f.read(end - start)
            k = block.rfind(b"\n")
            if k >= 0:
                return size if _is_object(block[k + 1 :] + tail) else start + k + 1
            tail, end = block + tail, start
        return size if _is_object(tail) else 0


def _is_object(raw: bytes) -> bool:
    try:
        return bool(raw.strip()) and isinstance(json.loads(raw), dict)
    except ValueError:
        return False


def read_range(root: str, part: Range) -> Iterator[tuple]:
    """Lines that start in [start, end); a line that starts before belongs to the range before.

    The end is the file's size or that of a complete line, so what is read there
    without a line break is a line.
    """
    stem, at = _stem(part.path), part.start
    try:
        system, _ = _fs(root)
        with system.open_input_file(part.path) as f:
            if at > part.first:
                f.seek(at - 1)
                at += len(_line(f)) - 1  # the rest of a line that another range reads
            f.seek(at)
            while at < part.end:
                raw = _line(f)
                if not raw:
                    return
                breaks = 2 if raw.endswith(b"\r\n") else 1 if raw.endswith(b"\n") else 0
                body = raw[: len(raw) - breaks]
                yield part.path, stem, at, body.decode("utf-8", "replace"), breaks, at + len(raw)
                at += len(raw)
    except FileNotFoundError:
        return
    except OSError:
        yield part.path, stem, at, None, 0, at


def _line(f) -> bytes:  # noqa: ANN001
    out, step = b"", 1 << 16
    start = f.tell()
    while True:
        chunk = f.read(step)
        if not chunk:
            return out
        k = chunk.find(b"\n")
        if k >= 0:
            out += chunk[: k + 1]
            f.seek(start + len(out))
            return out
        out += chunk


def _ranges(path: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(path, a, min(a + split, end), start) for a in range(start, end, split)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.recursive = options["path"], options.get("recursive", "true").lower() == "true"
        self.split, self.start = int(options.get("split", 64 << 20)), int(options.get("start", 0))
        self.whole = options.get("whole", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        system, _ = _fs(self.path)
        out: list[Range] = []
        for p, size in sorted(list_files(self.path, self.recursive).items()):
            out += _ranges(p, self.start, complete_end(system, p, size) if self.whole else size, self.split)
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return read_range(self.path, partition) if partition.path else iter(())


class _Tail(DataSourceStreamReader):
    """Offsets are {path: bytes read}; a batch ends at complete lines. Only files whose size has changed are opened."""

    def __init__(self, options: dict) -> None:
        self.path, self.recursive = options["path"], options.get("recursive", "true").lower() == "true"
        self.split, self.initial = int(options.get("split", 64 << 20)), options.get("initial", "{}")
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": self.initial}

    def latestOffset(self) -> dict:  # noqa: N802
        system, _ = _fs(self.path)
        now: dict[str, tuple[int, int]] = {}
        for p, size in list_files(self.path, self.recursive).items():
            was = self.known.get(p)
            try:
                now[p] = was if was and was[0] == size else (size, complete_end(system, p, size))
            except OSError:  # not readable now: it keeps its offset and is tried again
                if was:
                    now[p] = (-1, was[1])
        self.known = now
        return {"files": json.dumps({p: end for p, (_, end) in sorted(now.items())})}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        # A file that shrank is not read again until it has grown past its offset.
        return [r for p, e in sorted(new.items()) if e > old.get(p, 0) for r in _ranges(p, old.get(p, 0), e, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return iter(list(read_range(self.path, partition)))


class TranscriptLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Tail(self.options)


def read_lines(spark: SparkSession, path: str, recursive: bool = True, split: int = 64 << 20, start: int = 0, whole: bool = False) -> DataFrame:
    spark.dataSource.register(TranscriptLines)
    options = {"recursive": str(recursive), "split": split, "start": start, "whole": str(whole)}
    return spark.read.format("transcript_lines").options(**options).load(path)


def tail_lines(spark: SparkSession, path: str, recursive: bool = True, initial: dict[str, int] | None = None) -> DataFrame:
    spark.dataSource.register(TranscriptLines)
    reader = spark.readStream.format("transcript_lines").option("path", path).option("recursive", str(recursive))
    return reader.option("initial", json.dumps(initial or {})).load()
