"""Tables that the queries read as a store would have them: written once per session and input, below the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnstone.operators import fts
from turnstone.session import Scratch
from turnstone.sources.files import Folder

_KEPT: dict[tuple[str, str, str, str], Scratch] = {}


def _version(spark: SparkSession, path: str) -> str:
    """Sizes and times of a table's files."""
    folder = Folder(spark, path)
    status = folder._fs.listStatus(folder.path())
    return ",".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in status))


def _once(spark: SparkSession, d: str, name: str, kind: str, write: Callable[[Scratch], None]) -> str:
    key = (spark.sparkContext.applicationId, d, kind, _version(spark, f"{d}/{name}.parquet"))
    if key not in _KEPT:
        scratch = Scratch(spark, kind)
        write(scratch)
        _KEPT[key] = scratch
    return _KEPT[key].root


def text_index(spark: SparkSession, d: str, name: str, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, totals) of ``docs`` (doc_id, content), which come from the table ``name``."""
    root = _once(spark, d, name, f"index-{name}", lambda scratch: fts.write_index(docs, scratch.root))
    return fts.read_index(spark, [root], docs.schema["doc_id"].dataType.simpleString())
