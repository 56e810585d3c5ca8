"""Queries of incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstone.operators.incremental import LogRuns, committed, new_batch_root
from turnstone.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """A run over the turns: what is pending is written under its batch identifier and committed; the rows are those of that batch."""
    turns = table(spark, d, "turn").select("id", "transcript_file", "turn_index", "written_at")
    runs = LogRuns(spark, new_batch_root(spark, "p5"))
    batch = runs.run(turns, table(spark, d, "index_state"), lambda pending: pending.select("id").distinct())
    return runs.output(batch) if batch else turns.select("id").where("false")


def p5_manifest(spark: SparkSession, d: str) -> DataFrame:
    return committed(table(spark, d, "index_state")).select("transcript", "offset")


MANIFEST = """
select transcript, "offset" from (
  select regexp_extract(trim(transcript_path), '([^/\\\\]+)[/\\\\]*$', 1) as transcript, last_byte_offset as "offset",
         row_number() over (partition by regexp_extract(trim(transcript_path), '([^/\\\\]+)[/\\\\]*$', 1)
                            order by saved_at desc, last_byte_offset) as k, saved_at
  from index_state where run_status = 'ok' and saved_at is not null) where k = 1"""

QUERIES = {"p5_found": p5_found, "p5_manifest": p5_manifest}
SQL = {
    "p5_found": f"""
with s as ({MANIFEST.replace('select transcript, "offset" from', 'select transcript, "offset", saved_at from')})
select distinct t.id from turn t left join s on t.transcript_file = s.transcript
where s.transcript is null or t.turn_index >= s."offset" or t.written_at > s.saved_at""",
    "p5_manifest": MANIFEST,
}
