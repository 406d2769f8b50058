"""Mixing sources to target weights by Poisson replication, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import as_text, documents

TEMPER = 0.7  # target weight of a source: its bytes to this power
SEED = "mix-1"
# Sources up to which the table of rates is sent to all tasks; a longer one is joined like any table.
BROADCAST_SOURCES = 10_000


def hashed_unit(*parts: Column) -> Column:
    """A number from 0 up to 1 from 52 bits of a digest of the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """Distribution function of a Poisson number at 0, 1, 2 and on, to where it cannot be told from 1; empty for rate zero."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")

    def step(a: Column, k: Column) -> Column:
        log = a["log"] + F.log(rate) - F.log(k)
        total = a["total"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("total"), F.concat(a["steps"], F.array(total)).alias("steps"))

    first = F.exp(-rate)
    start = F.struct((-rate).alias("log"), first.alias("total"), F.array(first).alias("steps"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["steps"])).otherwise(
        F.array(F.lit(1.0))
    )


def rates(docs: DataFrame, source: str, text: str, weights: dict | None, total: int | None) -> DataFrame:
    """``_source, rate, steps`` for every source: mean repetitions of its rows so that its bytes meet the target."""
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.octet_length(as_text(text)) + 1).alias("_bytes"))
    if weights is None:
        weight = F.pow(F.col("_bytes").cast("double"), F.lit(TEMPER))
    else:
        weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])[F.col("_source")], F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.withColumn("_weight", weight)
    whole = sizes.agg(F.sum("_bytes").alias("_all"), F.sum("_weight").alias("_weights"))
    wanted = F.col("_all") if total is None else F.lit(total)
    rate = F.when(F.col("_weights") > 0, wanted * F.col("_weight") / F.col("_weights") / F.col("_bytes")).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(whole)).select("_source", rate.alias("rate")).withColumn("steps", poisson_steps(F.col("rate")))


def mix(docs: DataFrame, weights: dict | None = None, total: int | None = None, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The columns of ``docs`` in struct ``_row`` with ``copy`` (1, 2, ...), ``rate`` and ``shuffle_key``, in the order of the last.

    Each row is repeated a Poisson number of times whose mean makes the bytes of its source meet the source's share of
    ``total`` (the bytes there are, if not given). Weights are given by source, those not listed being zero, or come from
    tempered bytes. The number is the inverse distribution at a hash of seed, key and text, so it does not depend on the
    order of rows or on retries; many rows have none. Null is a source of its own, nulls in key or text are hashed as a mark,
    and repeated rows share their number. Bytes are those of the text plus 1.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    digest = F.md5(as_text(text).cast("binary"))
    named = F.coalesce(F.col(key).cast("string"), F.lit("-"))
    rows = docs.select(row.alias("_row"), F.col(source).alias("_of"), named.alias("_key"), digest.alias("_digest"))
    table = rates(docs, source, text, weights, total)
    if table.select("_source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    drawn = rows.join(table, F.col("_of").eqNullSafe(F.col("_source")))
    drawn = drawn.withColumn("_unit", hashed_unit(F.lit(seed), F.col("_key"), F.col("_digest")))
    times = F.size(F.filter("steps", lambda s: s <= F.col("_unit")))
    copies = drawn.withColumn("_times", times).where("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("copy"), "_key", "_digest").cast("binary"))
    return copies.select("_row", "copy", "rate", order.alias("shuffle_key")).orderBy("shuffle_key")


def op8_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have tempered weights, shuffled."""
    return mix(documents(spark, sf_dir)).select("_row.doc_id", "_row.text", "_row.lang", "_row.source", "_row.n_chars", "copy", F.round("rate", 9).alias("rate"), "shuffle_key")


QUERIES = {"op8_poisson_mix": op8_poisson_mix}


def mixed_sql(table: str, extra: str) -> str:
    """SQL for ``mix`` with its defaults over a table of documents; ``extra`` is selected beside their columns."""
    return f"""
    sizes as (select source s, sum(strlen(coalesce(text, '')) + 1)::bigint b from {table} group by 1),
    rated as (select s, (select sum(b) from sizes) * pow(b::double, {TEMPER}) / (select sum(pow(b::double, {TEMPER})) from sizes) / b rate from sizes),
    logs as (select s, rate, k, -rate + k * ln(rate) - coalesce(sum(case when k > 0 then ln(k) end) over (partition by s order by k), 0) l
             from rated, range(0, 400) r(k)),
    steps as (select s, rate, k, sum(exp(l)) over (partition by s order by k) c from logs
              where k <= ceil(rate + 12 * sqrt(rate) + 40)),
    listed as (select s, any_value(rate) rate, list(c) steps from steps group by s),
    units as (select d.*, md5(coalesce(text, '')) digest,
              ('0x' || md5('{SEED}:' || coalesce(doc_id::varchar, '-') || ':' || md5(coalesce(text, '')))[1:13])::bigint / 4503599627370496.0 u
              from {table} d),
    counted as (select units.*, rate, len(list_filter(steps, lambda z: z <= u)) n from units join listed on source is not distinct from s),
    mixed as (select doc_id, text, lang, source, n_chars, rate, digest, unnest(range(1, n + 1))::int copy from counted)
    select doc_id, text, lang, source, n_chars{extra} from mixed"""


SQL = {
    "op8_poisson_mix": "with "
    + mixed_sql("documents", f", copy, round(rate, 9) rate, md5('{SEED}:' || copy || ':' || coalesce(doc_id::varchar, '-') || ':' || digest) shuffle_key")
}
