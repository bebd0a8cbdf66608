"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text import WORD, or_empty
from tickloom.session import cut_lineage

#: More sources than this are joined by a shuffle and not sent to every executor.
BROADCAST_SOURCES = 100_000


def word_count(text: Column | str) -> Column:
    return F.regexp_count(or_empty(text), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """source, source_size, target, rate from rows of (source, size); one row per source.

    Sources in code-point order, null last, take the weights in turn and share `share` times the sum of all sizes.
    No target exceeds `most` times its source's size; what is cut off goes to the others by weight until none is
    above. That fixed point gives every source that is not cut the same target per weight, so it is found with one
    running sum over the sources ordered by (limit / weight). The table has one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*(F.lit(float(w)) for w in weights))
    one = totals.withColumn("_w", F.element_at(turn, (place % len(weights) + 1).cast("int"))).withColumn(
        "_limit", F.col("source_size") * F.lit(float(most))
    )
    every = Window.partitionBy()
    up = Window.orderBy((F.col("_limit") / F.col("_w")), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    # the target per weight if this source and all with a higher limit per weight are not cut
    one = one.withColumn("_per", left / weight_left).withColumn("_free", F.col("_limit") > F.col("_per") * F.col("_w"))
    level = F.min(F.when(F.col("_free"), F.struct((F.col("_limit") / F.col("_w")).alias("k"), "_per"))).over(every)
    one = one.withColumn("_level", level["_per"])
    target = F.when(F.col("_level").isNull(), F.col("_limit")).otherwise(
        F.least(F.col("_limit"), F.col("_level") * F.col("_w"))
    )
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return one.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, doc_id: Column, seed: int) -> Column:
    """floor(rate), plus one with probability equal to the fraction, drawn from a hash of seed and id."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    draw = F.conv(digits, 16, 10).cast("double") / float(2**52)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def with_rates(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Joins the targets of its source to each row; nothing is shuffled while the sources are few."""
    t = targets.withColumnRenamed("source", "_source")
    if t.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    return rows.join(t, rows["source"].eqNullSafe(t["_source"])).drop("_source")


def mix(docs: DataFrame, seed: int = 7, **rules) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document, in words.

    A null text has no words; a null source is a source, the last one; a source without words has target 0 and its
    documents are taken 0 times. Rows that repeat an id draw alike. An empty table gives an empty result. Other
    columns are ignored. A draw depends on seed and id alone, so reruns and lost tasks give the same mix.
    """
    sized = cut_lineage(docs.select(F.col("doc_id").cast("long"), "source", word_count("text").alias("size")))
    targets = cut_lineage(source_targets(sized, **rules))
    taken = copies(F.col("rate"), F.col("doc_id"), seed) * F.col("size")
    return with_rates(sized, targets).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, **rules) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns. Texts are never shuffled."""
    targets = cut_lineage(source_targets(docs.select("source", word_count("text").alias("size")), **rules))
    rows = docs.select(F.struct("*").alias("row"), "source", "doc_id")
    times = F.array_repeat(F.lit(1), copies(F.col("rate"), F.col("doc_id"), seed))
    return with_rates(rows, targets.select("source", "rate")).select("row", F.explode(times)).select("row.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 2 * n AS cap FROM t),
-- round by round: share by weight, cut at the limit, share the rest among those not cut
fill(round, source, place, weight, cap, target, fixed, open) AS (
  SELECT 0, source, place, weight, cap, 1.5 * sum(n) OVER () * weight / sum(weight) OVER (), false, true FROM w
  UNION ALL
  SELECT round + 1, source, place, weight, cap,
         CASE WHEN fixed OR target >= cap THEN cap
              ELSE target + weight * coalesce(sum(CASE WHEN target > cap THEN target - cap END) OVER (), 0)
                            / sum(CASE WHEN NOT fixed AND target < cap THEN weight ELSE 0 END) OVER () END,
         fixed OR target >= cap, max(target - cap) OVER () > 1e-9
  FROM fill WHERE open),
f AS (SELECT place, arg_max(target, round) AS target FROM fill GROUP BY place),
r AS (SELECT w.source, w.n, f.target, least(f.target / nullif(w.n, 0), 2.0) AS rate FROM w JOIN f USING (place))
SELECT doc_id, size, n::BIGINT AS source_size, target,
       (size * (floor(coalesce(rate, 0)) + CASE WHEN ('0x' || md5('7:' || doc_id)[1:13])::BIGINT / 4503599627370496.0 < coalesce(rate, 0) - floor(coalesce(rate, 0)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
