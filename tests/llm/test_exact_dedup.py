import hashlib
import re

from pyspark.sql import functions as F

from tests.llm.helpers import docs_of, rows_of
from tickloom.llm import exact_dedup as E

ROWS = [(5, "a b"), (3, "ab"), (4, "a  b"), (1, None), (2, " \n"), (9, "ab"), (9, "ab"), (None, "q"), (7, "x\u00a0"), (8, "x"), (6, "zz " * 4000), (10, "zz" * 4000)]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for normal, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0]))
        left = True
        for m in sorted(members, key=lambda m: -len(m[1])):
            kept = left and m[0] == keep[0] and len(m[1]) == len(keep[1])
            left = left and not kept
            out.append((m[0], keep[0], len(members), kept, hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_nulls_and_repeats(spark):
    docs = docs_of(spark, ROWS).withColumn("kept", F.lit("x")).withColumn("_hash", F.lit(1))
    assert rows_of(E.exact_dedup(docs)) == brute(ROWS)


def test_collisions_are_told_apart_by_bytes(spark):
    weak = lambda c: F.substring(F.md5(c), 1, 0)  # noqa: E731  every text has the same hash
    assert rows_of(E.exact_dedup(docs_of(spark, ROWS), hash_of=weak)) == brute(ROWS)


def test_keep_one_of_each(spark):
    docs = docs_of(spark, ROWS).withColumn("_sha", F.lit("mine"))
    kept = E.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == sorted((i is None, i) for i in (4, 2, None, 7, 8, 6))


def test_empty(spark):
    assert E.exact_dedup(docs_of(spark, [])).count() == 0
    assert E.keep_one_of_each(docs_of(spark, [])).count() == 0
