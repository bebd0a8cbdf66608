import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.helpers import docs_of
from tickloom.llm import exact_dedup, mixing, ngram_join, quality
from tickloom.llm.text import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contracts(spark):
    docs = table(spark, SF, "documents")
    before, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.cut_lineage(stage(spark, before, SF))
        assert after.columns == docs.columns
        ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
        if name == "quality rules":
            want = ids(quality.judge(before, table(spark, SF, "labels")).where("kept"))
        elif name == "exact dedup":
            want = ids(exact_dedup.exact_dedup(before).where("kept"))
        elif name == "n-gram Jaccard join":
            want = ids(ngram_join.near_duplicates(before).where("doc_id = component_id"))
        else:
            want = sorted(r["doc_id"] for r in mixing.mix(before).collect() for _ in range(r["taken"] // r["size"] if r["size"] else 0))
        assert ids(after) == want and want
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count() and last.where("NOT round_trip").count() == 0


def test_every_stage_takes_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of(spark, []), SF).count() == 0


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op3_chat_formatting", "op5_source_mixing"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    near = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert near(got) == near(want)


def test_eleven_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
