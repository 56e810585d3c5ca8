"""Continuous ingestion: tail transcripts, assemble turns, append what is new."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnstone.functions import text
from turnstone.operators import turns
from turnstone.session import Scratch
from turnstone.sources import transcripts
from turnstone.sources.store import Store

log = logging.getLogger(__name__)
#: Files that failed, kept for another try: by path the offset where reading ended and the number of tries.
FAILED = "FAILED"
TRIES = 5


class Counters:
    """What an ingest has done so far: turns found and added, files, batches, errors."""

    def __init__(self) -> None:
        self.turns = self.added = self.files = self.batches = self.errors = 0

    def as_dict(self) -> dict[str, int]:
        return dict(vars(self))


def process(store: Store, lines: DataFrame, base: str, counters: Counters | None = None) -> int:
    """Turns of a batch of lines into the store, then the offsets reached; how many turns were new.

    Repeating a batch adds nothing. A file that could not be read (a row with a
    null line) is noted and tried again with later batches, the others go on.
    """
    counters = counters if counters is not None else Counters()
    scratch = Scratch(store.spark, "ingest")
    try:
        lines = scratch.save(lines, "delivered")
        slugs = [F.lit(x) for pair in store.slugs().items() for x in pair]
        roots = F.create_map(*slugs) if slugs else F.create_map().cast("map<string,string>")
        root = F.coalesce(F.try_element_at(roots, text.slug_of_path(F.col("path"), base)), F.lit(""))
        facts = turns.from_json_lines(lines.where("line is not null")).withColumn("project_root", root)
        built = scratch.save(turns.assemble(facts, scratch, key="path"), "turns")
        added = store.add(built)
        ends = lines.where("line is not null").groupBy("path").agg(F.max("next_offset").alias("offset"))
        ends = scratch.save(ends.withColumn("project_root", root), "ends")
        store.save_offsets(ends)
        counters.turns, counters.added = counters.turns + built.count(), counters.added + added
        counters.files, counters.batches = counters.files + ends.count(), counters.batches + 1
        failed = {r.path: r.at for r in lines.where("line is null").groupBy("path").agg(F.min("byte_offset").alias("at")).collect()}
        if failed:
            counters.errors += len(failed)
            log.warning("%d files could not be read, among them %s", len(failed), min(failed))
            known = store.note(FAILED)
            store.save_note(FAILED, known | {p: {"offset": at, "tries": known.get(p, {}).get("tries", 0)} for p, at in failed.items()})
        return added
    finally:
        scratch.drop()


def retry(store: Store, base: str, counters: Counters | None = None) -> int:
    """Another try at files that could not be read; a file that fails ``TRIES`` times is left to the operator's hand."""
    added = 0
    for path, was in sorted(store.note(FAILED).items()):
        if was["tries"] >= TRIES:
            continue
        known = store.note(FAILED)
        known.pop(path, None)
        store.save_note(FAILED, known)
        try:
            added += process(store, transcripts.read_lines(store.spark, path, start=was["offset"], whole=True), base, counters)
            again = store.note(FAILED).get(path)
        except Exception as e:  # noqa: BLE001 - one file must not stop the others
            log.warning("%s: %s", path, e)
            again = was
        if again:
            store.save_note(FAILED, store.note(FAILED) | {path: {"offset": again["offset"], "tries": was["tries"] + 1}})
    return added


def start(
    spark: SparkSession, store: Store, folder: str, checkpoint: str, seconds: float | None = 2.0, recursive: bool = True,
    counters: Counters | None = None,
) -> StreamingQuery:
    """The ingest stream. ``seconds`` None processes what is there and ends (backfill).

    Batches are serial and end at line breaks; the checkpoint holds the byte
    offset of every file, a new stream begins at the offsets that the store
    knows. A batch that fails is run again as a whole, and the store's anti join
    keeps what it had added already from being repeated. A turn whose lines come
    in two batches is assembled per batch: the first part ends with its batch.
    """
    base = folder.removeprefix("file://")
    initial = {path: x["offset"] for path, x in store.state().items() if path.startswith(base)}
    lines = transcripts.tail_lines(spark, folder, recursive, initial)

    def batch(df: DataFrame, _: int) -> None:
        process(store, df, base, counters)
        retry(store, base, counters)

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def status(query: StreamingQuery, counters: Counters | None = None) -> dict:
    p = query.lastProgress
    out = {"active": query.isActive, "message": query.status["message"], "batch": p["batchId"] if p else None, "rows": p["numInputRows"] if p else 0}
    return out | (counters.as_dict() if counters else {})
