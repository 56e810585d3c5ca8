"""Processing only new or changed records (problem 5).

The same four steps at two granularities:

1. *listing*: what is there, one row per file or log, with size and checksum;
2. an anti join of the listing against the *manifest* of what has been done;
3. the pending part is written under a batch identifier that follows from it, so
   a run that failed and is repeated replaces what it had written;
4. the manifest is committed by a marker file that appears whole or not at all.

``FileRuns`` does this for folders of files, ``LogRuns`` for records of
append-only logs whose committed positions are kept in a table of runs. A run
that fails before step 4 leaves nothing that counts, so no record is skipped or
repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.session import Scratch
from turnstone.sources.files import Folder


def file_name(path: Column) -> Column:
    """Last component of a path; outer blanks and trailing or doubled separators do not matter."""
    return F.regexp_extract(F.trim(path), r"([^/\\]+)[/\\]*$", 1)


def committed(state: DataFrame) -> DataFrame:
    """The manifest: (transcript, offset, saved_at), one row per transcript.

    Only rows of runs that ended well (``run_status`` ok) count, of these the
    latest; repeated rows change nothing. Of rows with the same time the lowest
    offset counts, so that at worst records are processed again.
    """
    ok = state.where((F.col("run_status") == "ok") & F.col("saved_at").isNotNull())
    latest = ok.groupBy(file_name(F.col("transcript_path")).alias("transcript")).agg(
        F.max(F.struct("saved_at", (-F.coalesce("last_byte_offset", F.lit(0))).alias("negative"))).alias("s")
    )
    return latest.select("transcript", (-F.col("s.negative")).alias("offset"), F.col("s.saved_at").alias("saved_at"))


def _covered() -> Column:
    """Whether a record lies before the committed position of its log and was not written after that commit; never null."""
    return F.coalesce((F.col("turn_index") < F.col("_offset")) & (F.col("written_at") <= F.col("_saved_at")), F.lit(False))


def log_listing(records: DataFrame) -> DataFrame:
    """(log, size, checksum) of the records of each log, and of those that the committed run covers (``done_size``, ``done_checksum``).

    ``records``: id, turn_index, written_at, with ``_log``, ``_offset`` and
    ``_saved_at`` of the manifest (null without an entry). The size is the
    number of records, the checksum a sum of hashes that does not depend on
    their order. Sums combine before the shuffle, so a log with a third of all
    records is one row per task.
    """
    code = F.xxhash64("id", "turn_index", "written_at").bitwiseAND(0xFFFFFFFFFF)
    done = _covered()
    return records.groupBy("_log").agg(
        F.count("*").alias("size"), F.sum(code).alias("checksum"),
        F.count_if(done).alias("done_size"), F.coalesce(F.sum(F.when(done, code)), F.lit(0)).alias("done_checksum"),
    )


def pending_records(turns: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of ``turns`` that the committed runs do not cover.

    The listing of logs (size and checksum of their records) is anti joined with
    the manifest (size and checksum of the records that the committed run had
    seen); of the logs that are left, records are compared one by one: one is
    covered if it starts before the committed offset and was not written after
    that commit. A null transcript, position or time is never covered: such rows
    are processed again rather than lost. A null committed offset covers
    nothing. The manifest has one row per log, so a log with a third of all rows
    is split by adaptive skew handling on the side of the turns, and the
    manifest is only broadcast if its measured size permits.
    """
    done = committed(state).select(F.col("transcript").alias("_log"), F.col("offset").alias("_offset"), F.col("saved_at").alias("_saved_at"))
    log = file_name(F.col("transcript_file"))
    joined = turns.withColumn("_log", log).join(done, "_log", "left")
    listing = log_listing(joined.select("_log", "id", "turn_index", "written_at", "_offset", "_saved_at"))
    manifest = listing.select("_log", F.col("done_size").alias("size"), F.col("done_checksum").alias("checksum"))
    changed = listing.join(manifest, ["_log", "size", "checksum"], "left_anti").select(F.col("_log").alias("_changed"))
    own = joined.where(~_covered())
    return own.join(changed, own["_log"].eqNullSafe(F.col("_changed")), "left_semi").select(*turns.columns)


class LogRuns:
    """Runs over the records of logs: pending ones are written under a batch identifier and committed by a marker."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.folder = spark, Folder(spark, root)

    def run(self, records: DataFrame, state: DataFrame, process: Callable[[DataFrame], DataFrame] = lambda df: df) -> str | None:
        """Writes what ``process`` makes of the pending records; the batch identifier, or None if nothing is pending.

        The identifier follows from the pending records, so repeating a run that
        failed replaces its partial output and repeating one that ended well
        changes nothing.
        """
        scratch = Scratch(self.spark, "runs")
        try:
            pending = scratch.save(pending_records(records, state), "pending")
            code = F.xxhash64(*[c for c in pending.columns if c in ("id", "transcript_file", "turn_index", "written_at")])
            total = pending.agg(F.count("*").alias("n"), F.sum(code.bitwiseAND(0xFFFFFFFFFF)).alias("s"), F.bit_xor(code).alias("x")).first()
            if not total.n:
                return None
            batch = f"{total.n:x}-{total.s:x}-{total.x & (1 << 64) - 1:x}"
            if not self.folder.exists(f"commits/{batch}"):
                process(pending).write.mode("overwrite").parquet(f"{self.folder.root}/data/{batch}")
                self.folder.create(f"commits/{batch}", json.dumps({"records": total.n}))
            return batch
        finally:
            scratch.drop()

    def output(self, batch: str) -> DataFrame:
        """The rows of a committed batch."""
        if not self.folder.exists(f"commits/{batch}"):
            raise ValueError(f"{batch} was not committed")
        return self.spark.read.parquet(f"{self.folder.root}/data/{batch}")


def _fs(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


_BLOCK = 8 << 20


def _with_checksums(files: DataFrame) -> DataFrame:
    """Adds ``checksum`` (XXH3, 128 bits) of the first ``size`` bytes, read in blocks; files that vanished fall away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: list[str | None] = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = _fs(path)
                h, left = xxhash.xxh3_128(), size
                try:
                    with system.open_input_stream(name) as f:
                        while left and (block := f.read(min(left, _BLOCK))):
                            h.update(block)
                            left -= len(block)
                    sums.append(h.hexdigest() if not left else None)
                except FileNotFoundError:
                    sums.append(None)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["path", "size", "modified", "checksum"])
            yield out.filter(out.column("checksum").is_valid())

    return files.mapInArrow(run, "path string, size bigint, modified timestamp, checksum string")


def read_lines(files: DataFrame) -> DataFrame:
    """(path, position, line) of the first ``size`` bytes of files (path, size, checksum).

    A file that no longer has the checksum of its listing fails the run, which
    then leaves nothing that counts. Files are read as streams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, checksum in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "checksum"))):
                system, name = _fs(path)
                h, left, rest, at = xxhash.xxh3_128(), size, b"", 0
                with system.open_input_stream(name) as f:
                    while left:
                        block = f.read(min(left, _BLOCK))
                        if not block:
                            break
                        h.update(block)
                        left -= len(block)
                        *lines, rest = (rest + block).split(b"\n")
                        if not left and rest:
                            lines, rest = [*lines, rest], b""
                        if lines:
                            starts = []
                            for x in lines:
                                starts.append(at)
                                at += len(x) + 1
                            text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(starts, pa.int64()), pa.array(text, pa.string())], names=["path", "position", "line"])
                if h.hexdigest() != checksum:
                    raise RuntimeError(f"{path} has changed since it was listed")

    return files.mapInArrow(run, "path string, position bigint, line string")


class FileRuns:
    """Runs over a folder of input files with a manifest in ``root``.

    Layout: ``manifest/batch=<id>`` (path, size, modified, checksum),
    ``data/batch=<id>`` and a marker ``commits/<number>-<id>`` per committed
    batch. Only batches with a marker count, and of a path only the rows of its
    latest batch: a file that grew or was replaced supersedes what it had given
    before. Nothing but counts and identifiers passes through the driver.
    """

    MANIFEST = "path string, size bigint, modified timestamp, checksum string, batch string"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.folder = spark, Folder(spark, root)

    def _batches(self) -> list[tuple[int, str]]:
        """(number, identifier) of the committed batches, one marker file each."""
        return sorted((int(n), b) for n, _, b in (x.partition("-") for x in self.folder.names("commits") if not x.startswith(".")))

    def _committed(self, kind: str, schema: str | None) -> DataFrame | None:
        batches = self._batches()
        if not batches:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", "true")
        numbers = F.create_map(*[F.lit(x) for n, b in batches for x in (b, n)])
        base = f"{self.folder.root}/{kind}"
        rows = reader.parquet(*[f"{base}/{b}" for _, b in batches])
        return rows.withColumn("_number", F.try_element_at(numbers, F.col("batch")))

    def manifest(self) -> DataFrame:
        """(path, size, modified, checksum, batch): of every path the latest committed version."""
        rows = self._committed("manifest", self.MANIFEST)
        if rows is None:
            return self.spark.createDataFrame([], self.MANIFEST)
        return rows.groupBy("path").agg(F.max_by(F.struct("size", "modified", "checksum", "batch"), "_number").alias("m")).select("path", "m.*")

    def listing(self, folder: str, pattern: str = "*") -> DataFrame:
        """(path, size, modified) of the input files; no content is read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
        return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def pending(self, folder: str, pattern: str = "*") -> DataFrame:
        """(path, size, modified, checksum) of files that are new or changed.

        What has the path, size and time of the manifest is passed over unread;
        of the rest, what has path, size and checksum of it is passed over too.
        """
        done = self.manifest()
        fresh = self.listing(folder, pattern).join(done, ["path", "size", "modified"], "left_anti").select("path", "size", "modified")
        return _with_checksums(fresh.repartition(F.col("path"))).join(done, ["path", "size", "checksum"], "left_anti")

    def run(self, folder: str, process: Callable[[DataFrame], DataFrame] = read_lines, pattern: str = "*") -> str | None:
        """Processes what is pending; the batch identifier, or None if nothing is.

        ``process`` gets (path, size, modified, checksum) and gives rows with
        their ``path``. The listing is written down first, so every step of a run
        sees the same one.
        """
        scratch = Scratch(self.spark, "runs")
        try:
            files = scratch.save(self.pending(folder, pattern).select("path", "size", "modified", "checksum"), "files")
            code = F.xxhash64("path", "size", "checksum")
            total = files.agg(F.count("*").alias("n"), F.sum(code.bitwiseAND(0xFFFFFFFFFF)).alias("s"), F.bit_xor(code).alias("x")).first()
            if not total.n:
                return None
            batches = self._batches()
            number = batches[-1][0] + 1 if batches else 1
            # The number makes a version that comes back later a batch of its own.
            batch = f"{number}-{total.n:x}-{total.s:x}-{total.x & (1 << 64) - 1:x}"
            process(files).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.folder.root}/data/{batch}")
            files.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.folder.root}/manifest/{batch}")
            if not self.folder.create(f"commits/{number:012d}-{batch}", ""):
                raise RuntimeError("another run has committed this batch")
            return batch
        finally:
            scratch.drop()

    def output(self) -> DataFrame:
        """The rows of every path's latest committed version."""
        rows = self._committed("data", None)
        if rows is None:
            raise ValueError("no batch was committed yet")
        return rows.drop("_number").join(self.manifest().select("path", "batch"), ["path", "batch"], "left_semi").drop("batch")


def new_batch_root(spark: SparkSession, label: str) -> str:
    """A folder of its own below the shared folder, removed when the process ends."""
    return f"{Scratch(spark, label).root}/{uuid.uuid4().hex[:8]}"
