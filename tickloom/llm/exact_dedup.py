"""Exact deduplication on a 128-bit content hash, with the bytes of each group compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text import SPACE_CHARS, or_empty, sha256_hex
from tickloom.session import cut_lineage


_DECIDED = ("doc_id", "_len", "keep_id", "group_size", "text_sha256")


def content_hash(normal: Column) -> Column:
    """128 bits of the normalised text, as 32 hex digits."""
    return F.md5(normal)


def normal_text(text: Column | str) -> Column:
    return F.translate(or_empty(text), SPACE_CHARS, "")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space. The row with the longest original text stays, then
    the smallest id. A null text is the empty text; all empty texts form one group. A null id sorts after all others.
    Rows that repeat an id with an equal text count in group_size and exactly one of them is kept. Other columns are
    ignored, whatever their names; an empty table gives an empty result.

    The text itself is a grouping key beside its hash, so equality inside a hash group is equality of bytes, and the
    partial aggregation sends each distinct text once per map task however many copies there are. Everything after
    it moves ids and hashes only; a hash that stands for several texts (a collision) is settled by a second join on
    the text, which reads nothing while there is none.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(or_empty(text_col)).alias("_len"),
        normal_text(text_col).alias("_normal"),
    ).withColumn("_hash", hash_of(F.col("_normal")))
    # the longest text first, then the smallest id; a null id loses
    best = F.max(F.struct("_len", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus")))
    texts = base.groupBy("_hash", "_normal").agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.select(
        "_hash",
        "_normal",
        (-F.col("_best.minus")).alias("keep_id"),
        "group_size",
        sha256_hex(F.col("_normal")).alias("text_sha256"),
    )
    one = cut_lineage(
        texts.groupBy("_hash").agg(
            F.count(F.lit(1)).alias("_texts"),
            *(F.first(c).alias(c) for c in ("keep_id", "group_size", "text_sha256")),
        )
    )
    rows = base.select("doc_id", "_hash", "_len")
    settled = rows.join(one.where("_texts = 1"), "_hash")
    clashing = one.where("_texts > 1").select("_hash")
    if not clashing.isEmpty():
        unsettled = base.join(clashing, "_hash", "left_semi").join(texts, ["_hash", "_normal"])
        settled = settled.select(*_DECIDED).unionByName(unsettled.select(*_DECIDED))
    # one row stays where the kept row itself is repeated
    repeat = F.row_number().over(
        Window.partitionBy("doc_id", "text_sha256").orderBy(F.col("_len").desc())
    )
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_repeat") == 1)
    return settled.withColumn("_repeat", repeat).select(
        "doc_id", "keep_id", "group_size", keeper.alias("kept"), "text_sha256"
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns and one row for each distinct text.

    A kept row is known by its id and the hash of its text, so rows that share an id are told apart.
    """
    decided = exact_dedup(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).cast("long").alias("_id"),
        sha256_hex(normal_text(text_col)).alias("_sha"),
        F.length(or_empty(text_col)).alias("_len"),
    )
    same = rows["_id"].eqNullSafe(decided["doc_id"]) & (rows["_sha"] == decided["text_sha256"])
    order = Window.partitionBy("_id", "_sha").orderBy(F.col("_len").desc())
    first = rows.join(decided, same).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY normal) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(normal) AS text_sha256
FROM d WINDOW w AS (PARTITION BY normal ORDER BY len DESC, doc_id)
"""
