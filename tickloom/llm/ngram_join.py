"""Near-duplicate documents by Jaccard similarity of word shingles: a prefix join on token combinations.

Shingles are the tokens. The stages:

1. *Count.* One pass over the texts deals the tokens of each distinct set to buckets by token; a bucket finds in how
   many sets a token stands (its frequency) and keeps tokens of two sets or more. Two sets share only such tokens, so
   a set of which less than the wanted share is kept has no partner, and the rest is verified on the kept tokens.
2. *Index.* Tokens are ordered by frequency. A prefix is long enough when its tokens outnumber those a partner may
   lack. A rare token counts one and is indexed alone. Frequent tokens fall into classes by hash, are indexed by pairs
   within a class, and a class of f tokens counts f - 1; the prefix is extended until the sum is reached. Two similar
   sets then share a rare token or a pair (each missing token takes at most one from the sum).
3. *Verify.* Of the sets under one index entry the least key is the pivot and is compared with the others. Sets that
   match their pivot are one group; a set that does not is compared with the group and with the other such sets in
   tiles of bounded size. So a group of n copies costs n comparisons, and no link between groups is lost.
4. *Components* of the links.

Equal sets are one set throughout: keys are 64-bit sums of token hashes, checked against a second sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.components import connected_components
from tickloom.llm.grams import Texts, combine, mix64, slices
from tickloom.llm.text import table
from tickloom.session import cut_lineage

SHINGLE, PERCENT = 5, 80
#: Tokens in more sets than this are indexed by pairs.
FREQUENT = 64
#: Sets per side of a tile.
TILE = 1024
#: Texts are dealt in slices of about so many bytes, into so many buckets per input partition.
DEAL_BYTES, BUCKETS_PER_PARTITION = 1 << 20, 4

_U = np.uint64
_ROWS = "kind byte, bucket int, doc_id long, n int, key long, second long, tokens binary, keys binary, counts binary"
_COUNTED = "kind byte, doc_id long, n int, key long, second long, token long, df int"


def document_tokens(t: Texts, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, token), sorted; a text of fewer words than a shingle has one token for all of them."""
    s, e, doc = t.words()
    word = mix64(t.hashes(t.prefix(), s, e) + _U(seed))
    inside = doc[: 1 - SHINGLE] == doc[SHINGLE - 1 :]
    token, at = combine(word, SHINGLE)[inside], doc[: 1 - SHINGLE][inside]
    n_words = np.bincount(doc, minlength=t.n)
    first = np.cumsum(n_words) - n_words
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        whole = [mix64(combine(word[first[d] : first[d] + n_words[d]], int(n_words[d])) + _U(n_words[d])) for d in short]
        token, at = np.concatenate([token, *whole]), np.concatenate([at, short])
    order = np.lexsort((token, at))
    token, at = token[order], at[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (at[1:] != at[:-1])
    return at[new], token[new]


def _deal(buckets: int, seed: int):
    """Per slice: a row per document, and the tokens of its distinct sets dealt to the buckets (6 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], DEAL_BYTES):
                part = batch.slice(a, b - a)
                t = Texts(part["text"], lower=True)
                doc, token = document_tokens(t, seed)
                n = np.bincount(doc, minlength=t.n)
                start = np.cumsum(n) - n
                total = lambda h: np.diff(np.append(_U(0), np.cumsum(h, dtype=np.uint64))[np.append(start, len(h))])
                key = mix64(total(mix64(token ^ _U(0x5851F42D4C957F2D))) + n.astype(np.uint64)).view(np.int64)
                second = mix64(total(mix64(token ^ _U(0x14057B7EF767814F))) + n.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(t.n, np.int8)),
                        pa.array((key.view(np.uint64) % _U(buckets)).astype(np.int32)),
                        part["doc_id"],
                        pa.array(n.astype(np.int32)),
                        pa.array(key),
                        pa.array(second),
                        *(pa.nulls(t.n, pa.binary()) for _ in range(3)),
                    ],
                    names=["kind", "bucket", "doc_id", "n", "key", "second", "tokens", "keys", "counts"],
                )
                once = np.zeros(t.n, bool)
                once[np.unique(key, return_index=True)[1]] = True
                doc, token = doc[once[doc]], token[once[doc]]
                if not len(token):
                    continue
                bucket = (token % _U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, doc, token = bucket[order], doc[order], token[order] // _U(buckets)
                six = np.ascontiguousarray(token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                run_start = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])]))
                run_key, run_size = key[doc[run_start]], np.diff(np.append(run_start, len(doc))).astype(np.uint32)
                row_start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                row_end = np.append(row_start[1:], len(bucket))
                lo, hi = np.searchsorted(run_start, row_start), np.searchsorted(run_start, row_end)
                m = len(row_start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ones(m, np.int8)),
                        pa.array(bucket[row_start]),
                        pa.nulls(m, pa.int64()),
                        pa.nulls(m, pa.int32()),
                        pa.nulls(m, pa.int64()),
                        pa.nulls(m, pa.int64()),
                        pa.array([six[i:j].tobytes() for i, j in zip(row_start, row_end, strict=True)], pa.binary()),
                        pa.array([run_key[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary()),
                        pa.array([run_size[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary()),
                    ],
                    names=["kind", "bucket", "doc_id", "n", "key", "second", "tokens", "keys", "counts"],
                )

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes the document rows on, and turns the dealt tokens into (set, token, frequency) rows of repeated tokens."""
    held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
    names = ["kind", "doc_id", "n", "key", "second", "token", "df"]
    for batch in batches:
        is_doc = pc.equal(batch["kind"], 0)
        docs = batch.filter(is_doc)
        if len(docs):
            yield pa.RecordBatch.from_arrays(
                [docs["kind"], docs["doc_id"], docs["n"], docs["key"], docs["second"], pa.nulls(len(docs), pa.int64()), pa.nulls(len(docs), pa.int32())],
                names=names,
            )
        dealt = batch.filter(pc.invert(is_doc))
        for bucket, *row in zip(*(dealt[c].to_pylist() for c in ("bucket", "tokens", "keys", "counts")), strict=True):
            held.setdefault(bucket, []).append(tuple(row))
    for bucket in list(held):
        rows = held.pop(bucket)
        six = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, 6)
        token = np.zeros((len(six), 8), np.uint8)
        token[:, :6] = six
        token = token.view("<u8").ravel()
        key = np.repeat(np.frombuffer(b"".join(r[1] for r in rows), np.int64), np.frombuffer(b"".join(r[2] for r in rows), np.uint32))
        order = np.argsort(token, kind="stable")
        sorted_ = token[order]
        same = sorted_[1:] == sorted_[:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        token, key = sorted_[again], key[order[again]]
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])[: len(token)]
        token, key = token[new], key[new]
        _, at, df = np.unique(token, return_inverse=True, return_counts=True)
        keep = df[at] > 1
        n = int(keep.sum())
        if n:
            whole = mix64(token[keep] + mix64(np.full(1, bucket + 1, np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(n, np.int8)),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.int32()),
                    pa.array(key[keep]),
                    pa.nulls(n, pa.int64()),
                    pa.array(whole),
                    pa.array(df[at][keep].astype(np.int32)),
                ],
                names=names,
            )


def counted_tokens(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The written table of stage 1: document rows (kind 0) and repeated tokens of sets (kind 1)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    many = buckets or BUCKETS_PER_PARTITION * max(1, rows.rdd.getNumPartitions())
    seed = 0
    while True:
        dealt = rows.mapInArrow(_deal(many, seed), _ROWS).repartition(many, "bucket")
        counted = cut_lineage(dealt.mapInArrow(_count, _COUNTED))
        by_key = counted.where("kind = 0").groupBy("key").agg(F.min("second").alias("x"), F.max("second").alias("y"))
        if by_key.where("x <> y").isEmpty():
            return counted
        seed += 1  # two sets have one key: other hashes tell them apart


def least_overlap(n: int) -> int:
    return -(-PERCENT * n // 100)


def index_entries(n: int, df: np.ndarray, token: np.ndarray) -> set[int]:
    """Entries of a set of n tokens, of which `token` are the repeated ones, ordered by (frequency, token)."""
    need = n - least_overlap(n) + 1 - (n - len(token))
    out: set[int] = set()
    for level in {x.bit_length() - 1 for x in (n, least_overlap(n), 100 * n // PERCENT)}:
        classes, missing = max(1, (1 << level) >> 3), need
        met: dict[int, list[int]] = {}
        singles, pairs = [], []
        for f, w in zip(df.tolist(), token.tolist(), strict=True):
            if missing <= 0:
                break
            if f <= FREQUENT:
                singles.append(w)
                missing -= 1
                continue
            others = met.setdefault((w >> 7) % classes, [])
            if others:
                missing -= 1
                pairs += [(v, w) for v in others]
            others.append(w)
        out.update(singles)
        if pairs:
            p = np.array(pairs, np.int64).view(np.uint64)
            out.update(mix64(mix64(p[:, 0] + _U(level + 1)) + p[:, 1]).view(np.int64).tolist())
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ordered = batch["ordered"]
        ends = np.cumsum(np.asarray(pc.list_value_length(ordered)))[:-1]
        df, token = (np.split(np.asarray(ordered.flatten().field(c)), ends) for c in ("df", "token"))
        found = [index_entries(n, f, w) for n, f, w in zip(batch["n"].to_pylist(), df, token, strict=True)]
        entry = np.array([e for entries in found for e in entries], np.int64)
        key = np.repeat(np.asarray(batch["key"]), [len(entries) for entries in found])
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(key)], names=["entry", "key"])


def similar(common: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (n + sizes - common)


def tile_links(tile: pa.Table) -> pa.Table:
    """Links of a tile that join different groups: each set of side 1 with side 0, or, without side 0, among side 1.

    Side 0 is one group already, so one link to it is enough.
    """
    sets = {(s, k): (n, w) for s, k, n, w in zip(*(tile[c].to_pylist() for c in ("side", "key", "n", "tokens")), strict=True)}
    right = [(k, *v) for (s, k), v in sorted(sets.items()) if s == 1]
    base = [(k, *v) for (s, k), v in sorted(sets.items()) if s == 0] or right
    among = base is right
    sizes = np.array([n for _, n, _ in base])
    owner = np.repeat(np.arange(len(base)), [len(w) for _, _, w in base])
    token = np.concatenate([np.array(w, np.int64) for _, _, w in base])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    group = np.arange(len(base))
    links = []
    for i, (k, n, w) in enumerate(right):
        mine = np.array(w, np.int64)
        lo, hi = np.searchsorted(token, mine, "left"), np.searchsorted(token, mine, "right")
        c = hi - lo
        place = np.arange(c.sum()) + np.repeat(lo - (np.cumsum(c) - c), c)
        fits = similar(np.bincount(owner[place], minlength=len(base)), n, sizes)
        if among:
            for j in np.flatnonzero(fits & (group != group[i])).tolist():
                if group[j] != group[i]:
                    links.append((k, base[j][0]))
                    group[group == group[j]] = group[i]
        elif fits.any():
            links.append((k, base[int(np.argmax(fits))][0]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def links_of(sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets (key, n, ordered) that connect all sets which links connect at all."""
    entries = cut_lineage(sets.where("n >= 4").mapInArrow(_index, "entry long, key long"))
    pivots = entries.groupBy("entry").agg(F.min("key").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pairs = entries.join(pivots, "entry").where("key <> pivot").select("pivot", "key").distinct()
    plain = sets.select("key", "n", F.transform("ordered", lambda x: x["token"]).alias("tokens"))
    pivot_sets = plain.select(F.col("key").alias("pivot"), F.col("n").alias("pivot_n"), F.col("tokens").alias("pivot_tokens"))
    both = pairs.join(plain, "key").join(pivot_sets, "pivot")
    common = F.size(F.array_intersect("tokens", "pivot_tokens"))
    linked = common * 100 >= (F.col("n") + F.col("pivot_n") - common) * PERCENT
    compared = cut_lineage(both.select("pivot", "key", linked.alias("linked")))
    # what is left to compare: sets that do not match their pivot, with those that do and among themselves
    left = compared.groupBy("pivot").agg(
        F.count_if("linked").alias("inside"), F.count_if(~F.col("linked")).alias("outside")
    ).where("outside > 0 AND inside + outside > 1")
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    m = compared.join(left.select("pivot", tiles("inside").alias("ni"), tiles("outside").alias("no")), "pivot")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.pmod(F.xxhash64("key"), F.when(F.col("linked"), F.col("ni")).otherwise(F.col("no"))).cast("int")
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    m = m.withColumn("mine", mine).withColumn("others", upto("no")).withColumn("insiders", upto("ni"))
    cells = F.when(F.col("linked"), F.transform("others", lambda y: cell("group", F.col("mine"), y))).otherwise(
        F.concat(
            F.transform("insiders", lambda x: cell("group", x, F.col("mine"))),
            F.transform("others", lambda y: cell("rest", F.least("mine", y), F.greatest("mine", y))),
        )
    )
    m = m.select("pivot", "key", F.when(F.col("linked"), 0).otherwise(1).alias("side"), F.explode(cells).alias("cell"))
    tiled = m.join(plain, "key").select("pivot", "cell.*", "side", "key", "n", "tokens")
    more = tiled.groupBy("pivot", "kind", "x", "y").applyInArrow(tile_links, "a long, b long")
    return compared.where("linked").select(F.col("pivot").alias("a"), F.col("key").alias("b")).union(more)


def near_duplicates(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    A text without words (or null) has no shingles and is linked with nothing: its component is its own id. Rows that
    repeat an id are judged by their own texts. A null id has the component of its links, the least id that is not
    null, or null. An empty table gives an empty result; other columns are ignored.
    """
    counted = counted_tokens(docs, buckets)
    rows = counted.where("kind = 0").select("doc_id", "n", "key")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"))
    tokens = counted.where("kind = 1").select("key", "token", "df")
    repeated = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("r"))
    hopeful = classes.join(repeated, "key").where(F.col("r") * 100 >= F.col("n") * PERCENT).select("key", "n")
    sets = tokens.join(hopeful, "key").groupBy("key").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ordered")
    )
    joined = connected_components(links_of(cut_lineage(sets)))
    least = classes.join(joined, F.col("key") == F.col("node")).groupBy("component").agg(F.min("least_id").alias("c"))
    by_node = joined.join(least, "component").select(F.col("node").alias("key"), "c")
    # written, so that the join below is one that adaptive execution splits where many rows have one set
    named = cut_lineage(
        classes.join(by_node, "key", "left").select(F.col("key").alias("_key"), F.coalesce("c", "least_id").alias("component_id"))
    )
    sized = rows.withColumn("_of", F.when(F.col("n") > 0, F.col("key")))
    found = sized.join(named, F.col("_of") == F.col("_key"), "left")
    mine = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), mine.alias("component_id"))


def keep_one_of_group(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the row with the smallest id.

    Rows are told apart by a number of their own, so rows that repeat an id stay or go by their own texts. Rows with a
    null id all stay. Columns of any name come through: the row travels as one struct beside its number.
    """
    given = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given")
    rows = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), given))  # written, so that the numbers hold
    groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), "given.text"))
    ids = rows.select("row", F.col("given.doc_id").cast("long").alias("id")).where("id IS NOT NULL")
    known = cut_lineage(groups.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row"))
    keepers = known.groupBy("component_id").agg(F.min(F.struct("id", "row"))["row"].alias("keep"), F.count(F.lit(1)).alias("n"))
    keepers = cut_lineage(keepers.where("n > 1").select("component_id", "keep"))  # written, as in near_duplicates
    gone = known.join(keepers, "component_id").where("row <> keep").select("row")
    return rows.join(gone, "row", "left_anti").select("given.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS m, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM d),
y AS (SELECT doc_id, m, i, concat_ws(' ', a, lead(a, 1) OVER q, lead(a, 2) OVER q, lead(a, 3) OVER q, lead(a, 4) OVER q) AS sh
      FROM x WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT doc_id, list_sort(list(DISTINCT hash(sh))) AS sh FROM y WHERE i <= greatest(m - 4, 1) GROUP BY doc_id),
s AS (SELECT d.doc_id, coalesce(z.sh, []) AS sh FROM d LEFT JOIN z USING (doc_id)),
g AS (SELECT min(doc_id) AS rep, len(sh) AS n, sh FROM s WHERE len(sh) > 0 GROUP BY sh),
t AS (SELECT rep, n, unnest(sh) AS x FROM g),
r AS (SELECT t.* FROM t JOIN (SELECT x FROM t GROUP BY x HAVING count(*) > 1) USING (x)),
-- a set that shares less than four fifths of its shingles with any others has no partner
k AS (SELECT r.* FROM r JOIN (SELECT rep FROM r GROUP BY rep, n HAVING 100 * count(*) >= 80 * n) USING (rep)),
p AS (SELECT a.rep AS a, b.rep AS b FROM k a JOIN k b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n
        HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT rep, rep FROM g UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN g ON g.sh = s.sh LEFT JOIN c USING (rep)
"""
