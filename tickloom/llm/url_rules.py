"""URL filtering by association rules that FP-growth mines from labelled pages."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.text import ascii_lower, or_empty, table
from tickloom.session import cut_lineage

BAD = "label=bad"


class Listed(NamedTuple):
    host: str
    path: str
    verdict: str


#: The listed rules of the contract.
LISTED = (
    Listed("org", "/", "allow"),
    Listed("example.org", "/es/", "block"),
    Listed("example.org", "/en/1", "block"),
    Listed("com", "/fr/", "allow"),
    Listed("com", "/de/", "block"),
)

#: A mined rule holds on at least so many bad pages, and its confidence is above the base rate by so many standard errors.
MIN_BAD, Z = 20, 3.0

#: Rules are mined from about so many labelled URLs (a sample by hash where there are more), which bounds the item sets
#: that the learner collects: an item stands on MIN_BAD of them at least.
MOST_LABELLED = 200_000

#: Mined rules up to this many postings go to every executor; beyond, postings and tokens meet in a shuffle.
BROADCAST_POSTINGS = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first :// and the next /, ? or #; path: from there to the next ? or #."""
    u = or_empty(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def listed_rule(host: Column, path: Column, rules: Sequence[Listed]) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; null without one."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.host + r.path).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits of the URL, marked by the part they stand in."""
    host, path = host_and_path(url)
    words = lambda c, mark: F.transform(
        F.filter(F.split(ascii_lower(c), "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x)
    )
    query = F.regexp_extract(or_empty(url), r"[?]([^#]*)", 1)
    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:"), words(query, "q:")))


def lower_bound(hits: Column, share: Column, z: float) -> Column:
    """Wilson's lower bound of a share, of which the hits are counted."""
    n = hits / share
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(
    pages: DataFrame, labels: DataFrame, min_bad: int = MIN_BAD, min_confidence: float = 0.6, min_lift: float = 1.5, z: float = Z,
    most_labelled: int = MOST_LABELLED,
) -> DataFrame:
    """rule (id), tokens, support, confidence: URL token combinations that mark bad pages.

    A page is bad if its label has quality 0 or toxic 1; a page with several labels counts once, as bad if one is.
    Tokens that stand in exactly the same labelled pages (same count and same two checksums of page hashes) are one
    item, so a long URL that repeats can not blow the item sets up; the smallest token stands for them. A rule holds on
    min_bad bad pages or more, at any number of labelled pages, and the lower bound of its confidence (z standard errors)
    lies above the share of bad pages. A rule whose token subset has a rule of at least its confidence is dropped.
    Support and lift are shares of all labelled pages mined. Of more than most_labelled labelled URLs a sample by hash is
    mined, so the learner's item sets are bounded at any size of the labels.
    """
    bad = F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(bad.alias("bad"))
    urls = pages.select(F.col("page_id").alias("doc_id"), "url").dropDuplicates(["doc_id", "url"])
    labelled = cut_lineage(urls.join(known, "doc_id").select(F.xxhash64("doc_id", "url").alias("page"), "url", "bad"))
    parts = 1 << 30
    share = most_labelled / max(labelled.count(), most_labelled)
    mined = labelled.where(F.pmod(F.xxhash64("page"), F.lit(parts)) < int(share * parts))
    rows = cut_lineage(mined.select("page", "bad", F.explode_outer(url_tokens(F.col("url"))).alias("token")))
    total = rows.select(F.count_distinct("page").alias("n"), F.count_distinct(F.when(F.col("bad") == 1, F.col("page"))).alias("bad")).first()
    tokens = rows.where("token IS NOT NULL").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("marked"), F.bit_xor("page").alias("x"), F.bit_xor(F.xxhash64("page")).alias("y")
    )
    items = tokens.where(F.col("marked") >= min_bad).groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token")
    chosen = rows.join(items, "token", "left_semi").select("page", "token")
    marked = rows.where("bad = 1").select("page", F.lit(BAD).alias("token"))
    baskets = cut_lineage(chosen.unionByName(marked).groupBy("page").agg(F.collect_set("token").alias("items")))
    n = max(baskets.count(), 1)
    # half a page less than min_bad: the learner rounds up
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_bad - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).withColumn("bad", F.round(F.col("support") * n))
    base = F.lit(total["bad"] / max(total["n"], 1))
    found = found.where((F.col("bad") >= min_bad) & (F.col("confidence") >= min_lift * base) & (lower_bound(F.col("bad"), F.col("confidence"), z) > base))
    found = found.withColumn("support", F.col("bad") / F.lit(max(total["n"], 1)))
    rules = cut_lineage(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").withColumn("rule", F.xxhash64("tokens")))
    # pruned: a shorter rule inside it is at least as sure
    anchors = rules.select(F.explode("tokens").alias("t"), F.struct("rule", "tokens", "confidence").alias("long"))
    shorts = rules.select(F.col("tokens")[0].alias("t"), F.col("tokens").alias("short"), F.col("confidence").alias("c"))
    beaten = (
        anchors.join(shorts, "t")
        .where((F.size("short") < F.size("long.tokens")) & (F.size(F.array_except("short", "long.tokens")) == 0) & (F.col("c") >= F.col("long.confidence")))
        .select(F.col("long.rule").alias("rule"))
        .distinct()
    )
    return rules.join(beaten, "rule", "left_anti").select("rule", "tokens", "support", "confidence")


def matched_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, confidence of the surest rule all of whose tokens stand in the URL.

    The inverted index has one posting per rule, under its rarest token among the rules; a page meets a rule only
    through that token, and the rest of the rule is then looked up in the page's own tokens.
    """
    postings = rules.select("rule", "tokens", "confidence", F.explode("tokens").alias("token"))
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (
        postings.join(often, "token")
        .groupBy("rule")
        .agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("tokens").alias("needs"), F.first("confidence").alias("confidence"))
        .select("token", "needs", "confidence")
    )
    if index.limit(BROADCAST_POSTINGS + 1).count() <= BROADCAST_POSTINGS:
        index = F.broadcast(index)
    urls = pages.select("page_id", "url").withColumn("_tokens", url_tokens(F.col("url")))
    met = urls.select("page_id", "url", "_tokens", F.explode("_tokens").alias("token")).join(index, "token")
    fits = F.size(F.array_except("needs", "_tokens")) == 0
    return met.where(fits).groupBy("page_id", "url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, listed: Sequence[Listed] = LISTED, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence: one row per page.

    A listed rule decides; else the page is blocked if a mined rule matches its URL, and allowed if none does. A null
    url or one without :// has empty host and path and no tokens of a host; repeated rows are judged alike, each with
    a row of its own. Null ids, empty tables and other columns are fine; without labels nothing is mined.
    """
    hits = matched_pages(pages, cut_lineage(mine_rules(pages, labels, **limits)))
    hits = hits.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), "confidence")
    p = pages.select("page_id", "url")
    p = p.join(hits, p["page_id"].eqNullSafe(hits["_id"]) & p["url"].eqNullSafe(hits["_url"]), "left")
    host, path = host_and_path(F.col("url"))
    p = p.withColumn("host", host).withColumn("path", path)
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return p.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
