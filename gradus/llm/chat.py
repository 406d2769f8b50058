"""Chat training texts: every participant's view of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE = 64  # turns of a page
SYSTEM = "system"
NOBODY = "unknown"
END = "<|end|>\n"


def _header(role: Column, viewer: Column) -> Column:
    return (
        F.when(role == viewer, F.lit("<|assistant|>\n"))
        .when(role == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", page: int = PAGE) -> DataFrame:
    """``conv, participant, page, tie, n_turns, rendered, masks``: the dialogue as each participant sees it, in pages.

    For every participant (every role of the conversation but the system's) the dialogue is written with that speaker as
    assistant and the others as named users; the system's turns stay. ``masks`` are the stretches (start, stop in code
    points of ``rendered``) of the assistant's words and end marks, on which to train. A page holds the turns whose number
    divided by ``page`` gives its number, however long the conversation; of turns with the same number, each further
    ``page`` rows open a further ``tie``. Equal turn numbers are ordered by role, then text. A null turn is turn -1, a null
    text is empty, a null role is the participant ``unknown``; a null conversation is one of its own. A conversation with
    only system turns has no participant, so no rows. Repeated rows are all rendered.
    """
    rows = turns.select(
        F.col(conv).alias("_conv"), F.coalesce(F.col(turn).cast("bigint"), F.lit(-1)).alias("_turn"),
        F.coalesce(role, F.lit(NOBODY)).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"),
    )
    same = Window.partitionBy("_conv", "_turn").orderBy("_role", "_text")
    rows = rows.withColumn("_tie", F.floor((F.row_number().over(same) - 1) / page)).withColumn("_page", F.floor(F.col("_turn") / page))
    viewers = rows.where(F.col("_role") != SYSTEM).select(F.col("_conv").alias("_of"), F.col("_role").alias("participant")).distinct()
    seen = rows.join(viewers, F.col("_conv").eqNullSafe(F.col("_of")))
    said = F.struct(
        "_turn", "_role", "_text", F.length("_text").alias("size"), _header(F.col("_role"), F.col("participant")).alias("head"),
        (F.col("_role") == F.col("participant")).alias("own"),
    )
    pages = seen.groupBy("_conv", "participant", "_page", "_tie").agg(F.array_sort(F.collect_list(said)).alias("_said"))

    def walk(a: Column, s: Column) -> Column:
        start = a["at"] + F.length(s["head"])
        stop = start + s["size"] + len(END)
        mark = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(s["own"], F.concat(a["masks"], mark)).otherwise(a["masks"]).alias("masks"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("masks"))
    return pages.select(
        F.col("_conv").alias(conv), "participant", F.col("_page").alias("page"), F.col("_tie").alias("tie"),
        F.size("_said").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("_said", lambda s: F.concat(s["head"], s["_text"], F.lit(END))), "").alias("rendered"),
        F.aggregate("_said", empty, walk, lambda a: a["masks"]).alias("masks"),
    )


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side, with the stretches to train on."""
    out = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["stop"].cast("string"))), ",")
    return out.withColumn("masks", spans)


QUERIES = {"op3_chat": op3_chat}
SQL = {
    "op3_chat": f"""
    with r as (select conv_id, coalesce(turn, -1)::bigint t, coalesce(role, '{NOBODY}') r, coalesce(text, '') x from conversations),
    n as (select *, ((row_number() over (partition by conv_id, t order by r, x) - 1) // {PAGE})::bigint tie,
          floor(t / {PAGE})::bigint page from r),
    v as (select distinct conv_id c, r participant from r where r <> '{SYSTEM}'),
    s as (select n.*, participant, r = participant own,
          case when r = participant then '<|assistant|>' when r = '{SYSTEM}' then '<|system|>'
               else '<|user name=' || r || '|>' end || chr(10) head from n join v on conv_id is not distinct from c),
    p as (select *, sum(length(head) + length(x) + {len(END)}) over
          (partition by conv_id, participant, page, tie order by t, r, x rows unbounded preceding) stop from s)
    select conv_id, participant, page, tie, count(*) n_turns,
           string_agg(head || x || '<|end|>' || chr(10), '' order by t, r, x) rendered,
           coalesce(string_agg((stop - length(x) - {len(END)})::bigint || '-' || stop::bigint, ',' order by t, r, x) filter (own), '') masks
    from p group by 1, 2, 3, 4"""
}
