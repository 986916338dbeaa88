"""Multi-party perspective rotation, with DataFrame functions only.

For every participant (each role but system) a dialogue is rendered with that speaker as the assistant, the others as named
users and system turns as system; masks are the code-point spans of the assistant's own words, end exclusive.

Turns are ordered by turn, role and text, nulls first. A dialogue is rendered in parts of at most part_turns turn numbers,
one row a part, so that a conversation of any length is dealt over many tasks. Joining a dialogue's n_parts parts in order
gives the whole; offset is the place in it where a part begins, so that offset + mask is a mask of the whole dialogue. In texts
and names `<|` becomes `< |` and `|>` becomes `| >`, so that no one can write markup; masks count what is rendered.

Null texts are empty; null roles are `unknown`; null turns belong to part 0; null conv_ids form one conversation. Turns of one
conversation with one and the same number, or none, stand in one part. Repeated rows are rendered as often as they occur. A
conversation of system turns only has no perspective. Texts of any length are rendered whole. An empty table gives an empty
result; other columns are not carried, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import table

PART_TURNS = 512
# The markup.
ASSISTANT, SYSTEM, USER, USER_END, END = "<|assistant|>\n", "<|system|>\n", "<|user name=", "|>\n", "<|end|>\n"


def _plain(text: Column) -> Column:
    """Text without markup of its own."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS, system: str = "system") -> DataFrame:
    """conv_id, participant, part, n_parts, offset, n_turns, text, masks (array of start, end)."""
    role = F.coalesce("role", F.lit("unknown"))
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long")
    turns = conversations.select("conv_id", part.alias("part"), F.struct("turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    parts = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    speakers = conversations.select("conv_id", role.alias("participant")).where(F.col("participant") != system).distinct()
    rows = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.conv_id", "participant", "part", "turns")
    own = lambda r: r == F.col("participant")
    head = lambda r: F.when(own(r), F.lit(ASSISTANT)).when(r == system, F.lit(SYSTEM)).otherwise(F.concat(F.lit(USER), _plain(r), F.lit(USER_END)))
    segments = F.transform("turns", lambda t: F.struct(head(t["role"]).alias("head"), _plain(t["text"]).alias("text"), own(t["role"]).alias("own")))
    rows = rows.select("conv_id", "participant", "part", segments.alias("segments"))
    # One pass: the length so far and the spans.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, s):
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(s["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["text"], F.lit(END))), "")
    rows = rows.select("conv_id", "participant", "part", F.size("segments").cast("long").alias("n_turns"), text.alias("text"), F.aggregate("segments", start, step, lambda a: a["spans"]).alias("masks"))
    # Where parts begin follows from their lengths, summed by role first, so no text moves for it.
    sizes = turns.groupBy("conv_id", "part", F.col("t.role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(_plain(F.col("t.text")))).alias("chars"))
    length = F.sum(F.col("chars") + F.col("n") * (F.length(head(F.col("role"))) + len(END)))
    lengths = sizes.alias("z").join(speakers.alias("s"), F.col("z.conv_id").eqNullSafe(F.col("s.conv_id"))).select("z.conv_id", "participant", "part", "role", "n", "chars").groupBy("conv_id", "participant", "part").agg(length.alias("length"))
    dialogue = W.partitionBy("conv_id", "participant")
    offset = F.coalesce(F.sum("length").over(dialogue.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    places = lengths.select("conv_id", "participant", "part", F.count(F.lit(1)).over(dialogue).alias("n_parts"), offset.alias("offset"))
    same = F.col("r.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("r.participant") == F.col("o.participant")) & (F.col("r.part") == F.col("o.part"))
    return rows.alias("r").join(places.alias("o"), same).select("r.conv_id", "r.participant", "r.part", "n_parts", "offset", "n_turns", "text", "masks")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("masks", masks)


_P = lambda c: f"replace(replace({c}, '<|', '< |'), '|>', '| >')"
QUERIES = {"op4_chat_format": op4_chat_format}
SQL = {
    "op4_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS raw, {_P("coalesce(text, '')")} AS text, coalesce(CAST(floor(turn / {PART_TURNS}) AS BIGINT), 0) AS part FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
j AS (SELECT t.*, participant, t.role = participant AS own,
      CASE WHEN t.role = participant THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || {_P("t.role")} || '|>' || chr(10) END AS head
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, participant, part ORDER BY turn NULLS FIRST, role, raw) AS k FROM j),
c AS (SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, participant, part ORDER BY k ROWS UNBOUNDED PRECEDING) - 8 AS fin FROM n),
p AS (SELECT conv_id, participant, part, count(*) AS n_turns, string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(fin - length(text) AS VARCHAR) || ':' || CAST(fin AS VARCHAR), ',' ORDER BY k) FILTER (own), '') AS masks
FROM c GROUP BY conv_id, participant, part)
SELECT *, count(*) OVER (PARTITION BY conv_id, participant) AS n_parts,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, participant ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p"""
}
