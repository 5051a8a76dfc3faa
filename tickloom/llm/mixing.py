"""Mixing sources to target weights: block quotas split over output shards, native Spark only."""

from __future__ import annotations

import json

from numpy.random import Generator, default_rng
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, staged, table
from tickloom.llm.registry import query

C = F.col
WEIGHTS, CAP = (5, 2, 1), 3
#: Documents a block holds on average, and the most blocks a source is cut into.
BLOCK_DOCS, MAX_BLOCKS = 256, 65536


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The place of a document in the permutation of its source (32 hexadecimal digits)."""
    return F.md5(F.concat(F.coalesce(C(doc_id).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(C(text), F.lit("")).cast("binary"))).cast("binary"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``target`` to one row a source (``source, source_size``).

    Sources by code point, null last, weigh ``weights``, repeating, and share the size of all. No target exceeds ``cap`` times
    its source; what is cut there goes to the others by weight. Sorted by how soon a source fills, the full ones come
    first, so one pass finds them: the source at hand is full if its share of what the ones before it left reaches its cap.
    """
    order = Window.orderBy(C("source").asc_nulls_last())
    w = F.array(*[F.lit(x).cast("long") for x in weights])
    df = sources.withColumn("w", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(C("source_size") / C("w"), C("source").asc_nulls_last())
    df = df.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()),
        "before": F.sum(C("source_size") * cap).over(fill) - C("source_size") * cap,
        "w_rest": F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    df = df.withColumn("full", C("source_size") * cap * C("w_rest") <= C("w") * (C("total") - C("before")))
    everything = Window.partitionBy()
    rest = C("total") - F.sum(F.when(C("full"), C("source_size") * cap).otherwise(0)).over(everything)
    w_open = F.sum(F.when(~C("full"), C("w")).otherwise(0)).over(everything)
    share = (C("w") * rest).cast("double") / F.nullif(w_open, F.lit(0)).cast("double")
    df = df.withColumn("target", F.when(C("full"), (C("source_size") * cap).cast("double")).otherwise(share))
    return df.select(*sources.columns, "target")


def split_quotas(quotas: list[int], shards: int, rng: Generator) -> list[list[int]]:
    """Blocks of every source that each shard gets: a tree of multivariate hypergeometric draws.

    A node halves its shards and draws the left half's blocks, all at once and without replacement, from the blocks it
    holds; leaves are shards. Shards get equal numbers of blocks to within one, and no block twice.
    """
    if shards == 1:
        return [quotas]
    left = shards // 2
    drawn = rng.multivariate_hypergeometric(quotas, sum(quotas) * left // shards, method="marginals").tolist() if quotas else []
    return split_quotas(drawn, left, rng) + split_quotas([q - d for q, d in zip(quotas, drawn)], shards - left, rng)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shards: int = 16, seed: int = 7) -> DataFrame:
    """What the mix takes of every document: ``doc_id, source, key, size, source_size, target, copies``.

    Size is the number of words. ``copies`` holds the output shard of every copy of the document (empty: not taken).
    Documents lie in their source in the order of ``key``, cut into blocks of about ``BLOCK_DOCS``. A source is taken whole as
    often as its target allows; of the next pass come the first documents up to the target, and the one
    document more, from anywhere in the source, that brings the sum nearest to it. Each pass of each block is a unit;
    the units of a source are permuted and dealt to the shards by ``split_quotas``, which sees one number a source.

    Null texts and texts without words have size 0 and go with their block. Null sources are one source. Repeated rows are taken
    one by one; which of them is taken makes no difference. Reruns agree. An empty table gives no rows.
    """
    spark = docs.sparkSession
    narrow = staged(docs.select(
        C("doc_id").cast("long").alias("doc_id"), "source", document_key().alias("key"),
        F.coalesce(F.regexp_count(C("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-docs")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = source_targets(sources, weights, cap)
    whole = F.coalesce(F.floor(C("target") / F.nullif(C("source_size"), F.lit(0))), F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumns({
        "extra": C("target") - (C("whole") * C("source_size")).cast("double"),
        "n_blocks": F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), C("n_docs") / BLOCK_DOCS)).cast("long")})
    sources = staged(sources, "mix-sources")

    same = lambda a, b: C(f"{a}.source").eqNullSafe(C(f"{b}.source"))
    block = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * C("n_blocks") / 2**32).cast("long")
    placed = narrow.alias("d").join(sources.alias("s"), same("d", "s")).select("d.*", "s.source_size", "s.target", "s.whole", "s.extra", block.alias("block"))
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("block")) - C("words"))
    placed = placed.alias("d").join(blocks.alias("b"), same("d", "b") & (C("d.block") == C("b.block"))).select("d.*", "b.before")
    inside = Window.partitionBy("source", "block").orderBy("key")
    placed = placed.withColumns({
        "place": F.row_number().over(inside),
        "cum": C("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    placed = staged(placed.withColumn("prefix", (C("size") > 0) & (C("cum") <= C("extra"))), "mix-placed")

    gaps = placed.groupBy("source").agg(F.sum(F.when(C("prefix"), C("size")).otherwise(0)).alias("got"))
    gaps = gaps.alias("g").join(sources.alias("s"), same("g", "s")).select("g.source", (C("extra") - C("got")).alias("gap"))
    rest = placed.where(~C("prefix") & (C("size") > 0)).alias("d").join(gaps.alias("g"), same("d", "g"))
    rest = rest.where(F.abs(C("gap") - C("size")) < C("gap"))
    filler = rest.groupBy("d.source").agg(F.min(F.struct(F.abs(C("gap") - C("size")).alias("off"), "key", "block", "place")).alias("f"))
    filler = filler.select("source", "f.block", "f.place", F.lit(True).alias("fills"))
    placed = placed.alias("d").join(filler.alias("f"), same("d", "f") & (C("d.block") == C("f.block")) & (C("d.place") == C("f.place")), "left").select(
        "d.*", F.coalesce("fills", F.lit(False)).alias("fills"))
    passes = C("whole") + (C("prefix") | C("fills")).cast("long")
    placed = staged(placed.select("doc_id", "source", "key", "place", "size", "source_size", "target", "whole", "block", passes.alias("passes")), "mix-taken")

    held = placed.groupBy("source", "block").agg(F.max("passes").alias("passes"))
    units = held.where(C("passes") > 0).select("source", "block", F.explode(F.sequence(F.lit(1).cast("long"), C("passes"))).alias("turn"))
    name = F.md5(F.concat_ws("|", F.lit(str(seed)), "block", "turn").cast("binary"))
    units = staged(units.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(name, "block", "turn"))), "mix-units")
    # One number a source comes to the driver.
    totals = units.groupBy("source").count().orderBy(C("source").asc_nulls_last()).collect()
    per_shard = split_quotas([r["count"] for r in totals], shards, default_rng(seed))
    ends = [{"source": r["source"], "ends": [sum(q[i] for q in per_shard[: k + 1]) for k in range(shards)]} for i, r in enumerate(totals)]
    quotas = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<source:string,ends:array<long>>>")).alias("q")).select("q.*")
    shard = F.size(F.filter("ends", lambda e: e < C("rank")))
    dealt = units.alias("u").join(quotas.alias("q"), same("u", "q")).select("u.source", "block", F.struct("turn", shard.alias("shard")).alias("unit"))
    dealt = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    # The turns of a block are 1, 2, ... without a gap, so a document takes the first ones.
    copies = F.when(C("passes") > 0, F.slice(C("units.shard"), F.lit(1), C("passes").cast("int"))).otherwise(F.array().cast("array<int>"))
    out = placed.alias("d").join(dealt.alias("b"), same("d", "b") & (C("d.block") == C("b.block")), "left")
    return out.select("doc_id", "d.source", "key", "place", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, mixed: DataFrame, seed: int = 7, shard: str = "shard", position: str = "position") -> DataFrame:
    """The copies the mix takes, with the columns of ``docs`` and two more: their shard, and ``position``, the shuffled order in it.

    ``shard`` and ``position`` name these two; a column of ``docs`` of that name stays beside them, so give free names (``common.fresh``) to tell them apart.
    Null and repeated ids and texts keep their rows; an empty table gives none.
    """
    key = ["__id", "__key"]
    same_row = Window.partitionBy(*key).orderBy(F.lit(0))
    text = docs.select(F.struct(*[C(f"`{c}`") for c in docs.columns]).alias("__row"), F.coalesce(C("doc_id").cast("long"), F.lit(-(2**63))).alias("__id"), document_key().alias("__key"))
    text = text.withColumn("__n", F.row_number().over(same_row))
    plan = mixed.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), C("key").alias("__key"), "copies", "place")
    plan = plan.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("place"))).where(F.size("copies") > 0)
    out = text.join(plan, [*key, "__n"]).select("__row", "__key", "__n", F.posexplode("copies").alias("__copy", "__shard"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "__key", "__n", "__copy").cast("binary"))
    return out.select(*[C(f"__row.`{c}`").alias(c) for c in docs.columns], C("__shard").alias(shard), order.alias(position))


_MIX_SQL = """
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM s),
c AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
  (sum(3 * source_size) OVER f - 3 * source_size)::BIGINT AS before,
  (sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_rest
  FROM w WINDOW f AS (ORDER BY source_size / w, source NULLS LAST)),
u AS (SELECT *, 3 * source_size * w_rest <= w * (total - before) AS is_full FROM c),
t AS (SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE
  (w * (total - sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) OVER ())::BIGINT)::DOUBLE
  / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM u),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
x AS (SELECT *, target - (whole * source_size)::DOUBLE AS extra FROM e),
p AS (SELECT d.*, source_size, target, whole, extra, sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
q AS (SELECT *, size > 0 AND cum <= extra AS prefix FROM p),
g AS (SELECT *, extra - sum(CASE WHEN prefix THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM q),
r AS (SELECT *, CASE WHEN NOT prefix AND size > 0 AND abs(gap - size) < gap THEN
  row_number() OVER (PARTITION BY source, NOT prefix AND size > 0 AND abs(gap - size) < gap ORDER BY abs(gap - size), key) END AS nearest FROM g)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN prefix OR nearest = 1 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


@query("op1_mixing", _MIX_SQL)
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (C("size") * F.size("copies")).alias("taken"))
