"""Turns in versioned snapshots: Parquet folders and numbered pointer files.

Appends and deletes write a new version and then move the pointer; nothing is
overwritten while it may be read, a run that fails leaves the pointer where it
was. Appends only add files: a version is a list of folders, each with its own
full-text index, and is compacted when there are many. Inside a folder turns lie
in buckets by session, so that an append reads the buckets it touches only.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions import ids, text
from turnstone.operators import fts, vector
from turnstone.schema import DEFAULTS, TURNS
from turnstone.session import Scratch
from turnstone.sources.files import Folder

BUCKETS = 64
#: Folders of one version from which an append compacts.
MANY = 32
OFFSETS = "path string, offset bigint, project_root string, saved_at timestamp"
_STORED = T.StructType([*TURNS.fields, T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())])


def bucket(doc_id: Column) -> Column:
    """Bucket of a turn: that of its session, which the business key begins with."""
    return F.pmod(F.xxhash64(F.substring_index(doc_id, "::", 1)), F.lit(BUCKETS)).cast("int")


def schema_hash() -> str:
    """What the stored tables and the index look like; written with every version."""
    return hashlib.sha256(f"{_STORED.simpleString()}|{fts.POSTINGS}|{fts.STATS}|{BUCKETS}".encode()).hexdigest()[:16]


class Store:
    """One table of turns below ``root``; a single writer at a time, a second one fails."""

    def __init__(self, spark: SparkSession, root: str, model: str = vector.DEFAULT_MODEL) -> None:
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.folder = Folder(spark, self.root)
        self._begin()
        head = self.head()
        if head["folders"] and head["model"] != model:
            raise ValueError(f"the table was written with {head['model']}, not {model}; clear it first")
        if head["folders"] and head["schema"] != schema_hash():
            self.migrate()

    def _begin(self) -> None:
        """The first pointer, before anything else is written."""
        if not self.folder.numbers("HEAD") and not self.folder.exists("turns"):
            self.folder.advance("HEAD", json.dumps(self._empty()))

    def _empty(self) -> dict:
        return {"version": 0, "folders": [], "model": self.model, "schema": schema_hash()}

    def head(self) -> dict:
        """Pointer: version, folders, model, schema. A missing one is an error if there are turns, an unreadable one always."""
        body = self.folder.latest("HEAD")
        if body is None and self.folder.exists("turns"):
            raise ValueError(f"turns but no pointer below {self.root}")
        try:
            return self._empty() | (json.loads(body) if body is not None else {})
        except ValueError as e:
            raise ValueError(f"the pointer below {self.root} cannot be read") from e

    def _commit(self, folders: list[str]) -> None:
        self.folder.advance("HEAD", json.dumps({"version": self.head()["version"] + 1, "folders": folders, "model": self.model, "schema": schema_hash()}))

    def _read(self, folders: list[str], schema: T.StructType | None = _STORED) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _STORED)
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", "true")
        return reader.option("basePath", f"{self.root}/turns").parquet(*[f"{self.root}/turns/part={f}" for f in folders])

    def _rows(self) -> DataFrame:
        return self._read(self.head()["folders"])

    def turns(self, row_cap: int | None = None) -> DataFrame:
        df = self._rows().drop("part", "bucket")
        return df.limit(row_cap) if row_cap else df

    def _write(self, rows: DataFrame) -> str:
        """A new folder with its index; it counts once a pointer names it."""
        self._begin()
        name = uuid.uuid4().hex
        # Rebalanced by bucket: one file a bucket where it is small, several where one session is large.
        rows.withColumn("bucket", bucket(F.col("doc_id"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/turns/part={name}")
        self._index(name)
        return name

    def _index(self, name: str) -> None:
        docs = self._read([name]).select("doc_id", F.col("document").alias("content"))
        fts.write_index(docs, f"{self.root}/index/{name}")

    def add(self, turns: DataFrame) -> int:
        """Appends turns that are not there yet, embedded; how many they were.

        ``turns``: doc_id, content and metadata. Of rows with one doc_id the one
        of least turn_index is taken. The anti join comes before the embedding,
        so known turns cost no model time, and reads doc_ids of the buckets at
        hand only; the number is taken from what was written. Null doc_ids are
        left out.
        """
        scratch = Scratch(self.spark, "add")
        try:
            order = F.struct(F.coalesce("turn_index", F.lit(0)), F.xxhash64("content"))
            one = turns.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in turns.columns if c != "doc_id"]), order).alias("r")).select("doc_id", "r.*")
            one = scratch.save(one.withColumn("_bucket", bucket(F.col("doc_id"))), "batch")
            touched = [r[0] for r in one.select("_bucket").distinct().collect()]  # at most BUCKETS
            if not touched:
                return 0
            new = one.drop("_bucket").join(self._rows().where(F.col("bucket").isin(touched)).select("doc_id"), "doc_id", "left_anti")
            metadata = {c: F.coalesce(F.col(c), F.lit(v)) if c in new.columns else F.lit(v) for c, v in DEFAULTS.items()}
            document = text.stored(F.coalesce("content", F.lit("")))
            rows = scratch.save(new.select(ids.numeric_id(F.col("doc_id")).alias("id"), document.alias("document"), "doc_id", *[v.alias(k) for k, v in metadata.items()]), "new")
            n = rows.count()
            if n:
                folders = [*self.head()["folders"], self._write(rows.withColumn("vector", vector.embed("document", self.model)).select(*TURNS.fieldNames()))]
                self._commit(folders)
                if len(folders) > MANY:
                    self.compact()
            return n
        finally:
            scratch.drop()

    def delete(self, where: Column) -> int:
        """Removes the rows that match; how many they were. Rows for which the condition is null stay."""
        n = self.turns().where(where).count()
        if n:
            self._rewrite(self.turns().where(~F.coalesce(where, F.lit(False))))
        return n

    def compact(self) -> None:
        self._rewrite(self.turns())

    def migrate(self) -> None:
        """Rewrites turns and index that were written with another schema; what the turns lack is filled with defaults."""
        head = self.head()
        old = self._read(head["folders"], None)
        fields = {f.name: f.dataType for f in TURNS.fields}
        same = {f.name for f in old.schema.fields if f.name in fields and f.dataType.simpleString() == fields[f.name].simpleString()}
        self._rewrite(old.select(*[(F.col(c) if c in same else F.col(c).cast(t) if c in old.columns else F.lit(DEFAULTS.get(c)).cast(t)).alias(c) for c, t in fields.items()]))

    def _rewrite(self, survivors: DataFrame) -> None:
        self._commit([self._write(survivors)])

    def vacuum(self) -> None:
        """Removes folders that no version points to; call it when no reader of an old version is left."""
        keep = set(self.head()["folders"])
        for kind in ("turns", "index"):
            for name in self.folder.names(kind):
                if name.removeprefix("part=") not in keep:
                    self.folder.delete(f"{kind}/{name}")

    def clear(self) -> None:
        """Drops all rows, the full-text index and the offsets of the files read."""
        self.folder.delete()

    def build_index(self) -> None:
        """Writes the index of folders that lack one; appends and deletes write theirs themselves."""
        for name in self.head()["folders"]:
            if not self.folder.exists(f"index/{name}/stats/_SUCCESS"):
                self.folder.delete(f"index/{name}")
                self._index(name)

    def index(self) -> tuple[DataFrame, DataFrame]:
        """(postings, stats) of the present version: what the folders have, with no row of any other."""
        return fts.read_index(self.spark, [f"{self.root}/index/{f}" for f in self.head()["folders"]])

    # --- offsets of the files read: rows that are only added, the latest of a path counts
    def offsets(self) -> DataFrame:
        parts = [x for x in self.folder.names("offsets") if not x.startswith((".", "_"))]
        if not parts:
            return self.spark.createDataFrame([], OFFSETS)
        rows = self.spark.read.schema(OFFSETS).parquet(*[f"{self.root}/offsets/{x}" for x in parts])
        return rows.groupBy("path").agg(F.max_by(F.struct("offset", "project_root", "saved_at"), F.struct("saved_at", "offset")).alias("s")).select("path", "s.*")

    def state(self) -> dict[str, dict]:
        """Offsets by transcript path, for reports."""
        return {r.path: {"offset": r.offset, "project_root": r.project_root} for r in self.offsets().collect()}

    def offset(self, path: str) -> int:
        row = self.offsets().where(F.col("path") == path).first()
        return row.offset if row else 0

    def save_offsets(self, rows: DataFrame) -> None:
        """Adds (path, offset, project_root); a folder each time, put together when there are many."""
        now = rows.select("path", F.col("offset").cast("bigint").alias("offset"), "project_root", F.current_timestamp().alias("saved_at"))
        self._save_offsets(now)
        parts = [x for x in self.folder.names("offsets") if not x.startswith((".", "_"))]
        if len(parts) > MANY:
            self._save_offsets(self.offsets())
            for x in parts:
                self.folder.delete(f"offsets/{x}")

    def _save_offsets(self, rows: DataFrame) -> None:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/offsets/.{name}")
        self.folder._fs.rename(self.folder.path(f"offsets/.{name}"), self.folder.path(f"offsets/{name}"))

    # --- small states
    def note(self, name: str) -> dict:
        return json.loads(self.folder.latest(name) or "{}")

    def save_note(self, name: str, value: dict) -> None:
        self.folder.advance(name, json.dumps(value))

    def slugs(self) -> dict[str, str]:
        return self.note("SLUGS")

    def register_project(self, root: str) -> str:
        """Slug of a project root, saved if it is new or changed; the last root registered counts."""
        slug = root.replace("/", "-").replace(".", "-")
        known = self.slugs()
        if known.get(slug) != root:
            self.save_note("SLUGS", known | {slug: root})
        return slug

    def merge_older(self, older: DataFrame, last_expire: float | None = None) -> None:
        """Takes over offsets (path, offset, project_root) of paths not known here, and the later of the two expiry checks."""
        own = self.offsets()
        self.save_offsets(older.select("path", "offset", "project_root").join(own.select("path"), "path", "left_anti"))
        known = self.note("EXPIRE").get("last_expire_check", 0)
        if last_expire and last_expire > known:
            self.save_note("EXPIRE", {"last_expire_check": last_expire})
