"""Queries of the training-data operators, added to the registry by __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import conversation, neardup, pack, pii, residue, split, tokenize
from turnstone.plans import recall
from turnstone.session import Scratch, table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the oversized turns; a repeated turn counts once."""
    return split.split_oversized(table(spark, d, "turn")).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Turns that the splitting operator cut, hence those over the limit."""
    pieces = split.split_oversized(table(spark, d, "turn"))
    return pieces.where((F.col("piece") > 0) & (F.length("text") <= split.LIMIT)).select("id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lines, placed = conversation.paths(table(spark, d, "entry"), Scratch(spark, "p2"))
    return conversation.judge(lines, placed).select("session_id")


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversation.conversations(table(spark, d, "entry"), Scratch(spark, "p2"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = neardup.similar_sets(table(spark, d, "turn"), Scratch(spark, "p3"))
    return neardup.id_pairs(members, pairs)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "p3")
    members, pairs = neardup.similar_sets(table(spark, d, "turn"), scratch)
    return neardup.groups(members, pairs, scratch)


def p4_details(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    return pii.find_personal(table(spark, d, "turn"), table(spark, d, "name_list"), scratch)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_details(spark, d, Scratch(spark, "p4")).select("id", "kind", "found").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "p4")
    turns = table(spark, d, "turn").select("id", "content").distinct()
    return pii.redact(turns, scratch.save(p4_details(spark, d, scratch), "details"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, d, "documents"))


def p7_bins(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokenize.count_tokens(table(spark, d, "documents"))
    return pack.pack(sizes, Scratch(spark, "p7"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents")).select("doc_id").distinct()


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_conversations": p2_conversations, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_redacted": p4_redacted, "p6_ids": p6_ids, "p7_bins": p7_bins, "p8_found": p8_found, "p8_kept": p8_kept}


_BLANK = f"^{recall._SPACE[:-1]}*$"
#: Messages of each session in order, and what breaks it, by the statement of the problem.
_MESSAGES = f"""e as (select * from (select *, row_number() over (partition by session_id, byte_offset order by received_at) as rn from entry where session_id is not null) where rn = 1),
f as (select session_id, byte_offset, lower({recall._strip_sql('type')}) as kind, coalesce(is_meta, false) as meta, content, try_cast(nullif("timestamp", '') as timestamptz) as instant,
  case when json_valid(content) then content end as j from e),
g as (select *, coalesce(json_type(j) = 'ARRAY' and len(list_filter(json_extract(j, '$[*]'), lambda x : json_type(x) <> 'OBJECT')) = 0, false) as is_list,
  last_value(instant ignore nulls) over (partition by session_id order by byte_offset rows between unbounded preceding and current row) as moment from f),
h as (select *, case when is_list then list_filter(list_transform(list_filter(json_extract(j, '$[*]'), lambda x : json_extract_string(x, '$.type') = 'text'),
  lambda x : coalesce(json_extract_string(x, '$.text'), '')), lambda t : not regexp_matches(t, '{_BLANK}')) else [] end as said from g),
i as (select *, case when kind = 'user' and not meta and content is not null and not is_list and not regexp_matches(content, '{_BLANK}') then 'user'
  when kind = 'assistant' and is_list and len(said) > 0 then 'assistant' end as role,
  (kind in ('user', 'assistant') and not meta and content is null) or coalesce(kind = 'assistant' and starts_with(content, '[{{') and j is null, false) as broken from h),
m as (select session_id, role, content, said, row_number() over w - 1 as position, lag(role) over w as before, lead(role) over w as after from i where role is not null
  window w as (partition by session_id order by moment nulls first, byte_offset)),
d as (select session_id from i group by 1 having bool_or(broken) or count(role) = 0 union
  select session_id from m where (before is null and role = 'assistant') or (role = 'user' and coalesce(after, 'user') = 'user'))"""
_WORDS = "regexp_extract_all(lower(content), '[a-z0-9]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"select distinct id from turn where length(content) > {split.LIMIT}",
        "p2_found": f"with {_MESSAGES} select session_id from d",
        "p2_conversations": f"""with {_MESSAGES} select session_id, position, role, case when role = 'user' then content else array_to_string(said, chr(10) || chr(10)) end as text
from m where session_id not in (select session_id from d)""",
        "p3_found": f"""with t as (select distinct id, {_WORDS} as w from turn where content is not null), f as (select id, w from t where len(w) >= 30),
g as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from f), n as (select id, count(*) as n from g group by id),
p as (select a.id as id_a, b.id as id_b, count(*) as c from g a join g b on a.g = b.g and a.id < b.id group by 1, 2)
select id_a, id_b from p join n x on id_a = x.id join n y on id_b = y.id where c >= 0.7 * (x.n + y.n - c) - 1e-9""",
    }
