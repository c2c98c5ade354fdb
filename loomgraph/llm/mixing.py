"""Mixing sources to target weights by systematic sampling.

Each document of a source expects the same number of copies, target over
source size. The documents of a source stand in a fixed order; the running
sum of expected copies, shifted by one offset for the source, crosses some
whole numbers, and a document is emitted once for each that falls into its
own step. The order is by size, so that neighbours in it are alike and the
words taken stay within about one document of the target. All arithmetic is
on whole numbers and the offset is a digest of the seed and the source, so
reruns agree.

Defined results: a null text has no words; an empty table gives an empty mix;
a null source is a source of its own, last in the order; repeated rows are
separate documents; documents without words are never taken more than their
source's rate and add nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut, rank_within, row_key, running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # times its size that a source, and a document, may be taken


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source, given one row per source with ``source`` and ``source_size``.

    Sources in the order of their code points, null last, take the weights in
    turn. A target stops at ``most`` times its source's size and the excess is
    shared again by weight. That is one water level: with sources ordered by
    size over weight, the first few stop and the others get the same multiple
    of their weight.
    """
    ladder = F.array(*[F.lit(int(w)) for w in weights])
    turn = running(sizes.select("source", F.col("source_size").cast("long").alias("source_size"), F.col("source").isNull().alias("_none")), ["_none", "source"], [])
    weighed = turn.select(
        "source", "_none", "source_size", F.element_at(ladder, (F.col("_place") % len(weights) + 1).cast("int")).cast("long").alias("_w")
    ).withColumn("_rise", F.col("source_size") / F.col("_w"))
    sums = cut(running(weighed, ["_rise", "_none", "source"], ["source_size", "_w"]))
    every = sums.agg(F.sum("source_size").alias("all"), F.sum("_w").alias("w")).first()
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    total, left = F.lit(every["all"] or 0).cast("long"), F.lit(every["w"] or 0).cast("long") - F.col("_before__w")
    # The first source in this order that does not stop; all after it do not either.
    free = (total.cast("decimal(38,0)") - most * whole("_before_source_size")) * whole("_w") <= most * whole("source_size") * left.cast("decimal(38,0)")
    first = sums.where(free).agg(F.min(F.struct("_place", F.col("_before_source_size").alias("below"), left.alias("left"))).alias("f")).first()["f"]
    place, below, over = (first["_place"], first["below"], first["left"]) if first else (0, 0, 1)
    shared = sums.withColumn("_free", F.col("_place") >= place).withColumn("_share", total - most * F.lit(below).cast("long")).withColumn("_over", F.lit(over).cast("long"))
    target = F.when(F.col("_free"), F.col("_w").cast("double") * F.col("_share").cast("double") / F.col("_over").cast("double"))
    num = F.when(F.col("_free"), F.col("_w").cast("decimal(38,0)") * F.col("_share"))
    den = F.when(F.col("_free"), F.col("_over").cast("decimal(38,0)") * F.col("source_size"))
    return shared.select(
        "source",
        "source_size",
        F.coalesce(target, F.col("source_size").cast("double") * most).alias("target"),
        F.coalesce(num, F.lit(most)).cast("decimal(38,0)").alias("num"),
        F.coalesce(den, F.lit(1)).cast("decimal(38,0)").alias("den"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: int = 1,
    keyed: bool = True,
) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, source, size, source_size, target and copies, one row per
    row of ``docs``; if ``keyed``, also the ``row_key`` that ``emit`` needs.
    """
    own = ["row"] if keyed else []
    # Written once, since the ranges are sampled before the rows are dealt out: the texts are read once.
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), *[row_key(docs, text_col).alias(c) for c in own]))
    ranked = rank_within(rows, ["source"], ["size", "doc_id", *own], "_k")
    totals = ranked.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, most).withColumnRenamed("source", "_source")
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("null")))), 1, 8), 16, 10)
    targets = bounded(cut(targets.withColumn("_u", digest.cast("decimal(20,0)"))))
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    # offset = u / 2**32 of one step, in units of 1 / den, rounded down
    off = F.expr("case when den = 0 then 0 else (_u * cast(den as decimal(38,0))) div cast(4294967296 as decimal(12,0)) end").cast("decimal(38,0)")
    crossed = lambda k: f"((cast({k} as decimal(18,0)) * num + _off) div den)"
    copies = F.expr(f"case when den = 0 then cast(0 as bigint) else {crossed('_k + 1')} - {crossed('_k')} end")
    return joined.withColumn("_off", off).select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *own)


def emit(docs: DataFrame, copies: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of the mix itself: each document repeated as often as it is taken.

    ``copies`` is what ``mix`` gives for the same ``docs``. Rows that are equal
    in every column share their key; together they are taken as often as all.
    """
    taken = cut(copies.groupBy(F.col("row").alias("_key")).agg(F.sum("copies").alias("_times"), F.count(F.lit(1)).alias("_rows")))
    rows = docs.withColumn("_row", row_key(docs, text_col)).join(taken.where("_times > 0"), F.col("_row") == F.col("_key"))
    # Only where rows repeat in full do several answer to one count.
    if taken.where("_rows > 1").limit(1).count():
        rows = rows.dropDuplicates(["_row"])
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, keyed=False).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::hugeint as ss, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end::hugeint as w
  from d group by source
), o as (
  select *, sum(ss) over r - ss as below, sum(w) over () - sum(w) over r + w as lft, sum(ss) over () as al
  from s window r as (order by ss::double / w::double, source nulls last)
), f as (
  select *, max(case when (al - 3 * below) * w <= 3 * ss * lft then 1 else 0 end)
    over (order by ss::double / w::double, source nulls last) = 1 as fr from o
), g as (
  select *, al - 3 * (select min(below) from f where fr) as share, (select max(lft) from f where fr) as ov from f
), t as (
  select source, ss, case when fr then w::double * share::double / ov::double else ss::double * 3 end as target,
    case when fr then w * share else 3 end::hugeint as num, case when fr then ov * ss else 1 end::hugeint as den,
    ('0x' || substr(md5('1:' || coalesce('=' || source, 'null')), 1, 8))::bigint::hugeint as u
  from g
), k as (
  select d.*, (row_number() over (partition by source order by size, doc_id) - 1)::hugeint as k from d
)
select k.doc_id, k.size, t.ss::bigint as source_size, t.target,
  (case when den = 0 then 0 else ((k + 1) * num + (u * den) // 4294967296) // den - (k * num + (u * den) // 4294967296) // den end * k.size)::bigint as taken
from k join t on k.source is not distinct from t.source
"""
