"""Phrase collocations by count streams kept in prefix and suffix order.

1. *Count.* Words are numbered by 63 bits of a hash of language and word, so phrases are tuples of numbers. A slice of
   texts is counted by sorting: its phrases of one to three words in prefix order (by first word, then second, then
   third). The sorted counts are cut at fixed phrases into ranges and dealt to the ranges' buckets; the cuts come from a
   bounded sample and only balance the work, so a phrase or a first word in a third of all places spans many ranges.
   A bucket merges its slices and keeps phrases of LEAST places: no other phrase is a candidate or a part of one.
   Two words of one number are seen in the bucket that holds their counts, and all is numbered anew.
2. *Streams.* The kept counts are put in prefix order and in suffix order (last word first), each range-partitioned,
   sorted, and read once. In either order a phrase follows its own shorter beginnings, so the reader holds the last
   count of one and of two words and hands them on: left counts in prefix order, right counts in suffix order, and for
   a three-word phrase the counts of the two-word phrases that it extends. No count is looked up. What a range needs
   from before its beginning are two counts; ranges that lack them name them, and they are filled in.
3. *Score* in exact decimal arithmetic, drop what a longer candidate explains, and rank per language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.grams import Texts, mix64, slices
from tickloom.llm.text import or_empty, table
from tickloom.session import cut_lineage, ship_package

LEAST, TOP, PERCENT = 10, 2000, 50
#: Texts are counted in slices of about so many bytes, and their words numbered in smaller ones.
COUNT_BYTES, HASH_BYTES = 2 << 20, 1 << 19
#: Ranges per input partition; sampled documents and phrases of each that place the cuts.
RANGES_PER_PARTITION, SAMPLE_DOCS, SAMPLE_PHRASES = 8, 2000, 64

_U = np.uint64
_END = np.zeros(256, bool)
_END[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _END.copy()
_GAP[[0x20, 0x09]] = True
_DEALT = (
    "bucket int, words binary, langs array<string>, one binary, one_n binary, one_lang binary, "
    "two_head binary, two_fan binary, two binary, two_n binary, three_fan binary, three binary, three_n binary"
)
_NAMES = [c.split()[0] for c in _DEALT.split(", ")]
_COUNTED = "kind byte, lang string, w1 long, w2 long, w3 long, c long, word string"
#: Kinds of counted rows: all words of a language, a phrase of one to three words, two words of one number.
TOTAL, PHRASE, CLASH = 0, 1, 2


def _lang_seed(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a slice: number, language, whether the piece goes on after them; and where they stand in the bytes."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int):
        encoded = langs.dictionary_encode()
        self.langs = encoded.dictionary.to_pylist()
        seeds = np.array([_lang_seed(x, seed) for x in self.langs], np.uint64)
        lang_of, raw, parts, at = np.asarray(encoded.indices), [], [], 0
        for a, b in slices(texts, HASH_BYTES):
            t = Texts(texts.slice(a, b - a), lower=True)
            gap, first = _GAP[t.bytes], t.starts_doc
            begins, ends = ~gap, ~gap
            begins[1:] &= gap[:-1] | first[1:-1]
            ends[:-1] &= gap[1:] | first[1:-1]
            begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            if len(begin):
                doc = t.document_of(begin)
                lang = lang_of[a + doc]
                number = np.maximum((mix64(t.hashes(t.prefix(), begin, end) + seeds[lang]) >> _U(1)).astype(np.int64), 1)
                piece = np.cumsum(_END[t.bytes], dtype=np.int32)[begin]
                goes_on = np.append((doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]), False)
                parts.append((number, lang, goes_on, begin + at, end + at))
            raw.append(t.bytes)
            at += len(t.bytes)
        self.bytes = np.concatenate(raw) if raw else np.empty(0, np.uint8)
        none = tuple(np.empty(0, d) for d in (np.int64, np.int32, bool, np.int64, np.int64))
        self.number, self.lang, goes_on, self.begin, self.end = (np.concatenate(v) for v in zip(*(parts or [none]), strict=True))
        self.goes_on = goes_on[:-1]

    def word(self, i: int) -> bytes:
        return self.bytes[self.begin[i] : self.end[i]].tobytes()


def _ranks(w: Words):
    """Distinct numbers, and the sorted distinct phrases of two and three words as (rank, rank) codes with counts."""
    numbers, at, rank, n1 = np.unique(w.number, return_index=True, return_inverse=True, return_counts=True)
    rank = rank.astype(np.int64)
    pair = np.flatnonzero(w.goes_on)
    two, rank2, n2 = np.unique(rank[pair] << 32 | rank[pair + 1], return_inverse=True, return_counts=True)
    both = np.flatnonzero(np.diff(pair) == 1)
    three, n3 = np.unique(rank2[both].astype(np.int64) << 32 | rank[pair[both] + 2], return_counts=True)
    return numbers, at, n1, two, n2, three, n3


def _cuts(numbers: np.ndarray, two: np.ndarray, three: np.ndarray, splits: np.ndarray):
    """Where the ranges that begin at the splits (rows of three numbers) begin in the three sorted lists."""
    s1, s2, s3 = splits.T
    one = np.searchsorted(numbers, s1, "right")
    a = np.searchsorted(numbers, s1)
    there = a < one
    b = np.where(there, np.searchsorted(numbers, s2, "right"), 0)
    cut2 = np.searchsorted(two, a << 32 | b)
    c = np.searchsorted(numbers, s2)
    j = np.searchsorted(two, a << 32 | c)
    there &= (c < b) & (j < cut2)
    cut3 = np.searchsorted(three, np.where(there, j << 32 | np.searchsorted(numbers, s3), cut2 << 32))
    return one, cut2, cut3


def _count(splits: np.ndarray, seed: int):
    """Per slice and range one row: words, and the sorted counts as a tree of first, second and third words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in slices(batch["text"], COUNT_BYTES):
                w = Words(batch["text"].slice(x, y - x), batch["lang"].slice(x, y - x), seed)
                if not len(w.number):
                    continue
                numbers, at, n1, two, n2, three, n3 = _ranks(w)
                ends = [[0, *cut.tolist(), len(v)] for cut, v in zip(_cuts(numbers, two, three, splits), (numbers, two, three), strict=True)]
                first2, second2, head3, third3 = two >> 32, two & 0xFFFFFFFF, three >> 32, three & 0xFFFFFFFF
                rows = []
                for k in range(len(splits) + 1):
                    (a1, b1), (a2, b2), (a3, b3) = ((e[k], e[k + 1]) for e in ends)
                    if a1 == b1 and a2 == b2 and a3 == b3:
                        continue
                    own = a2
                    if a3 < b3:
                        a2 = min(a2, int(head3[a3]))  # the open phrase of two words, which counts nothing here
                    heads, fan = np.unique(first2[a2:b2], return_counts=True)
                    counts = n2[a2:b2].copy()
                    counts[: own - a2] = 0
                    names = sorted(set(w.lang[at[a1:b1]].tolist()))
                    rows.append(
                        (
                            k,
                            b"\n".join(map(w.word, at[a1:b1].tolist())),
                            [w.langs[i] for i in names],
                            numbers[a1:b1].tobytes(),
                            n1[a1:b1].astype("<u4").tobytes(),
                            np.searchsorted(names, w.lang[at[a1:b1]]).astype("<u4").tobytes(),
                            numbers[heads].tobytes(),
                            fan.astype("<u4").tobytes(),
                            numbers[second2[a2:b2]].tobytes(),
                            counts.astype("<u4").tobytes(),
                            np.bincount(head3[a3:b3] - a2, minlength=b2 - a2).astype("<u4").tobytes(),
                            numbers[third3[a3:b3]].tobytes(),
                            n3[a3:b3].astype("<u4").tobytes(),
                        )
                    )
                types = [pa.int32(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 10]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)

    return run


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts of equal keys added up, in order of the keys."""
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order].astype(np.int64)
    new = np.zeros(len(n), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    return [k[begin] for k in keys], np.add.reduceat(n, begin) if len(begin) else n


def _rows(kind: int, c, lang=None, w1=None, w2=None, w3=None, word=None) -> pa.RecordBatch:
    m = len(c)
    long = lambda v: pa.array(np.zeros(m, np.int64) if v is None else v, pa.int64())
    text = lambda v: pa.nulls(m, pa.string()) if v is None else pa.array(v, pa.string())
    columns = [pa.array(np.full(m, kind, np.int8)), text(lang), long(w1), long(w2), long(w3), long(c), text(word)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "lang", "w1", "w2", "w3", "c", "word"])


def _merge(least: int):
    """Adds up the slices of a range."""

    def bucket(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        cat = lambda name, dtype="<i8": np.frombuffer(b"".join(r[name] for r in rows), dtype)
        number, n = cat("one"), cat("one_n", "<u4").astype(np.int64)
        words = [x for r in rows if r["one"] for x in r["words"].split(b"\n")]
        known = {x: i for i, x in enumerate(sorted({x for r in rows for x in r["langs"]}))}
        langs = list(known)
        lang = [np.array([known[x] for x in r["langs"]], np.int64)[np.frombuffer(r["one_lang"], "<u4")] for r in rows if r["one"]]
        if len(number):
            lang = np.concatenate(lang)
            totals = np.bincount(lang, weights=None, minlength=len(langs)) > 0
            sums = np.zeros(len(langs), np.int64)
            np.add.at(sums, lang, n)
            yield _rows(TOTAL, sums[totals], lang=[x for x, held in zip(langs, totals, strict=True) if held])
            order = np.argsort(number, kind="stable")
            number, n, lang = number[order], n[order], lang[order]
            text = pa.array(words, pa.binary()).take(pa.array(order))
            same = number[1:] == number[:-1]
            alike = (lang[1:] == lang[:-1]) & np.asarray(pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False), bool)
            if (same & ~alike).any():
                yield _rows(CLASH, np.ones(1, np.int64))
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            total = np.add.reduceat(n, begin)
            kept = np.flatnonzero(total >= least)
            at = begin[kept]
            yield _rows(
                PHRASE, total[kept], lang=[langs[i] for i in lang[at].tolist()], w1=number[at],
                word=[x.decode() for x in text.take(pa.array(at)).to_pylist()],
            )
        first = np.repeat(cat("two_head"), cat("two_fan", "<u4"))
        second = cat("two")
        (a, b), n = _summed([first, second], cat("two_n", "<u4"))
        kept = n >= least
        yield _rows(PHRASE, n[kept], w1=a[kept], w2=b[kept])
        fan = cat("three_fan", "<u4")
        (a, b, c), n = _summed([np.repeat(first, fan), np.repeat(second, fan), cat("three")], cat("three_n", "<u4"))
        kept = n >= least
        yield _rows(PHRASE, n[kept], w1=a[kept], w2=b[kept], w3=c[kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["bucket"], []).append(row)
        batch = row = None  # the rows are held once
        for k in sorted(held):
            yield from bucket(held.pop(k))

    return run


def _sampled(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                w = Words(batch["text"].slice(i, 1), batch["lang"].slice(i, 1), seed)
                at = np.flatnonzero(w.goes_on[:-1] & w.goes_on[1:]) if len(w.number) > 2 else np.empty(0, np.int64)
                at = at[:: max(1, -(-len(at) // SAMPLE_PHRASES))]
                yield pa.RecordBatch.from_arrays([pa.array(w.number[at + d]) for d in range(3)], names=["w1", "w2", "w3"])

    return run


def _splits(rows: DataFrame, ranges: int, seed: int) -> np.ndarray:
    """Phrases that cut the prefix order into ranges of about equal size, from SAMPLE_DOCS documents or so."""
    share = SAMPLE_DOCS / max(1, rows.count())
    sample = rows if share >= 1 else rows.sample(share, 7)
    found = sample.mapInArrow(_sampled(seed), "w1 long, w2 long, w3 long").distinct().toPandas().to_numpy(np.int64)
    if not len(found):
        return np.empty((0, 3), np.int64)
    found = found[np.lexsort(found.T[::-1])]
    return np.unique(found[np.arange(1, ranges) * len(found) // ranges], axis=0)


def counted(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The written table of step 1: totals per language and the phrases of `least` places or more."""
    ship_package()
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), or_empty("text").cast("string").alias("text"))
    ranges = RANGES_PER_PARTITION * max(1, rows.rdd.getNumPartitions())
    seed = 0
    while True:
        dealt = rows.mapInArrow(_count(_splits(rows, ranges, seed), seed), _DEALT).repartitionById(ranges, F.col("bucket"))
        found = cut_lineage(dealt.mapInArrow(_merge(least), _COUNTED))
        if found.where(f"kind = {CLASH}").isEmpty():
            return found
        seed += 1


def _hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x1, x2, x3, c) in order; each gets the counts of (x1) and (x1, x2), or null before they were read."""
    one, two = (0, 0), (0, 0, 0)
    for batch in batches:
        x1, x2, x3, c = (np.asarray(batch[k]) for k in ("x1", "x2", "x3", "c"))
        if not len(c):
            continue
        at = np.arange(len(c))
        last1 = np.maximum.accumulate(np.where(x2 == 0, at, -1))
        last2 = np.maximum.accumulate(np.where((x2 > 0) & (x3 == 0), at, -1))
        h1, c1 = np.where(last1 < 0, one[0], x1[last1]), np.where(last1 < 0, one[1], c[last1])
        h2, g2, c2 = (np.where(last2 < 0, two[i], v[last2]) for i, v in enumerate((x1, x2, c)))
        one, two = (int(h1[-1]), int(c1[-1])), (int(h2[-1]), int(g2[-1]), int(c2[-1]))
        yield pa.RecordBatch.from_arrays(
            [*(batch[k] for k in ("x1", "x2", "x3", "c")), pa.array(c1, mask=h1 != x1), pa.array(c2, mask=(h2 != x1) | (g2 != x2))],
            names=["x1", "x2", "x3", "c", "c1", "c2"],
        )


def _stream(phrases: DataFrame, x1, x2, x3) -> DataFrame:
    """Phrases of two words or more in the order of (x1, x2, x3), with the counts of their beginnings c1 and c2."""
    keys = ["x1", "x2", "x3"]
    rows = phrases.select(x1.alias("x1"), x2.alias("x2"), x3.alias("x3"), "c")
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    read = cut_lineage(ordered.mapInArrow(_hand_on, "x1 long, x2 long, x3 long, c long, c1 long, c2 long").where("x2 > 0"))
    # at most one beginning of each length is open where a range begins: as many rows as ranges, so they are broadcast
    lone, pair = rows.where("x2 = 0"), rows.where("x2 > 0 AND x3 = 0")
    open1 = lone.join(F.broadcast(read.where("c1 IS NULL").select("x1").distinct()), "x1").select("x1", F.col("c").alias("o1"))
    open2 = pair.join(F.broadcast(read.where("c2 IS NULL").select("x1", "x2").distinct()), ["x1", "x2"]).select("x1", "x2", F.col("c").alias("o2"))
    filled = read.join(F.broadcast(open1), "x1", "left").join(F.broadcast(open2), ["x1", "x2"], "left")
    return filled.select(*keys, "c", F.coalesce("c1", "o1").alias("c1"), F.coalesce("c2", "o2").alias("c2"))


def _whole(x, y):
    """x div y"""
    return F.call_function("div", x, y)


def scored(phrases: DataFrame) -> DataFrame:
    """w1, w2, w3 (0: none), a, l, r, score of every candidate that no longer one explains."""
    w1, w2, w3 = F.col("w1"), F.col("w2"), F.col("w3")
    three = w3 > 0
    prefix = _stream(phrases, w1, w2, w3).select(
        F.col("x1").alias("w1"), F.col("x2").alias("w2"), F.col("x3").alias("w3"), F.col("c").alias("a"), F.col("c1").alias("p1"), F.col("c2").alias("p2")
    )
    turned = _stream(phrases, F.when(three, w3).when(w2 > 0, w2).otherwise(w1), F.when(three, w2).when(w2 > 0, w1).otherwise(0), F.when(three, w1).otherwise(0))
    x1, x2, x3 = F.col("x1"), F.col("x2"), F.col("x3")
    long = x3 > 0
    suffix = turned.select(
        F.when(long, x3).otherwise(x2).alias("w1"), F.when(long, x2).otherwise(x1).alias("w2"), F.when(long, x1).otherwise(0).alias("w3"),
        F.col("c1").alias("s1"), F.col("c2").alias("s2"),
    )
    both = cut_lineage(prefix.hint("merge").join(suffix, ["w1", "w2", "w3"]))
    # 7 + 15 + 15 digits and 18 + 18 digits stay within the 38 of a decimal
    big = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    score = lambda x, y: _whole(F.lit(1000000).cast("decimal(7,0)") * big("a", 15) * big("a", 15), big(x, 18) * big(y, 18))
    way1 = F.when(three, score("p1", "s2")).otherwise(score("p1", "s1"))
    way2 = F.when(three, score("p2", "s1"))
    later = F.coalesce(way2 < way1, F.lit(False))
    found = both.select(
        "w1", "w2", "w3", "a",
        F.when(later, F.col("p2")).otherwise(F.col("p1")).alias("l"),
        F.when(three & ~later, F.col("s2")).otherwise(F.col("s1")).alias("r"),
        F.when(later, way2).otherwise(way1).alias("score"),
    )
    explains = lambda c: both.where(three & (F.col("a") * 100 >= F.col(c) * PERCENT))
    gone = explains("p2").select("w1", "w2").union(explains("s2").select(w2.alias("w1"), w3.alias("w2"))).select("w1", "w2", F.lit(0).cast("long").alias("w3"))
    return found.join(gone.distinct(), ["w1", "w2", "w3"], "left_anti")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two or three words.

    Reads lang and text. A null language is `und`; a null or empty text has no words; repeated rows count as often as
    they stand. Phrases of one score are ordered by count and then by their UTF-8 bytes, so ranks have no ties. A text
    of any length is counted whole. An empty table gives an empty result; other columns are ignored.
    """
    found = counted(docs, least)
    totals = found.where(f"kind = {TOTAL}").groupBy("lang").agg(F.sum("c").alias("n"))
    phrases = found.where(f"kind = {PHRASE}")
    words = phrases.where("w2 = 0")
    spelled = scored(phrases)
    for k in (1, 2, 3):
        named = words.select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"t{k}"), *([F.col("lang")] if k == 1 else []))
        spelled = spelled.join(named, f"w{k}", "left")
    spelled = spelled.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "l", "r", "score")
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
      FROM documents),
p AS (SELECT i, lang, unnest(p) AS p, unnest(range(len(p))) AS j FROM d),
w AS (SELECT i, lang, j, unnest(w) AS a, unnest(range(len(w))) AS k FROM (SELECT i, lang, j, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p)),
g AS (SELECT lang, a, lead(a) OVER q AS b, lead(a, 2) OVER q AS c FROM w WINDOW q AS (PARTITION BY i, j ORDER BY k)),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f1 AS (SELECT lang, a, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
f2 AS (SELECT lang, a, b, count(*)::HUGEINT AS f FROM g WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, a, b, c, count(*)::HUGEINT AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.a = f2.a AND f3.b = f2.b AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.b = f2.a AND f3.c = f2.b AND 100 * f3.f >= 50 * f2.f)
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, x.f, y.f, 1
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, x.f, y.f, 2
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c),
s AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""
