import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of
from tickloom.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                "phone": lambda: 9 <= len(d) <= 15,
            }[kind]
            if ok():
                out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return [(a, e, k) for a, _, e, k in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a9@.-+ (0125", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_base_spans_on_cases():
    text = "é a.b+c@x-y.co.uk@d.e 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 4111 1111-1111 1111 +1 (234) 555-6789 +12 345 678"
    assert P.base_spans(text) == brute(text) and len(brute(text)) == 5
    assert P.base_spans("a" * 300_000 + "@") == [] and P.base_spans("1" * 200_000) == []


def test_trees_as_arrays_score_like_spark(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    df = spark.createDataFrame([(float(v), r.tolist()) for v, r in zip(y, x, strict=True)], "label double, x array<double>")
    df = df.select("label", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    raw = [r["rawPrediction"][1] for r in model.transform(df).collect()]
    assert np.allclose(P.node_arrays(model.toDebugString, 3).margins(x), np.array(raw))


def test_find_and_redact(spark):
    plain = " ".join(f"word{chr(97 + i % 26)} and the other" for i in range(60))
    rows = [(i, plain) for i in range(40)]
    secret = "password=1f0c9e55aa317bd24e"
    rows += [(50, f"{plain} mail hsr.29@mail5.example.com or {secret} now"), (51, None), (52, ""), (52, "é 13.216.148.142."), (53, "x" * 200_000)]
    docs = docs_of(spark, rows).withColumn("spans", F.lit("clash"))
    got = {(r["doc_id"], r["n_email"], r["n_ip"]): r for r in P.find(docs).collect()}
    assert len(got) == 45
    r = got[50, 1, 0]
    at = rows[40][1].index("hsr")
    assert r["base_sha256"] == hashlib.sha256(f"email:{at}:{at + 24}".encode()).hexdigest()
    assert f"email:{at}:{at + 24}" in r["spans"] and "secret:" in r["spans"]
    assert got[52, 0, 1]["spans"] == "ip:2:16" and got[52, 0, 0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(r["spans"] == "" for k, r in got.items() if k[0] < 50)
    hidden = {(r["doc_id"], r["text"]) for r in P.redact(docs.where("doc_id >= 50")).collect()}
    assert (52, "é <ip>.") in hidden and (51, None) in hidden
    assert not any("hsr" in (t or "") or "1f0c9e" in (t or "") for _, t in hidden)
    assert P.find(docs_of(spark, [])).count() == 0


def test_held_out_plants(spark):
    """Strings planted with seeds that training never saw: most personal ones are found, few look-alikes are."""
    docs = docs_of(spark, [(i, "der and the erheit von in thonder ") for i in range(300)])
    trees = P.train(docs)
    found = {True: [0, 0], False: [0, 0]}
    for seed in range(5_000_000, 5_000_150):
        text, where = P.planted("one the erheit of ander " * 60, seed)
        _, spans = P.all_spans(text, trees, 0.9)
        for a, b, good in where:
            found[good][0] += any(s < b and a < e for s, e, _ in spans)
            found[good][1] += 1
    assert found[True][0] / found[True][1] > 0.85 and found[False][0] / found[False][1] < 0.08


def test_long_secrets_are_proposed_whole():
    key = "Ab" * 60 + "7" + "xY+/" * 500
    assert (4, 4 + len(key), "secret") in P.propose(f"key {key} end")
    assert (0, 9 + len(key), "secret") in P.propose(f"password={key} end")
    mail = "a" * 90 + " (at) " + "b" * 90 + " (dot) org"
    assert (0, len(mail), "email") in P.propose(mail + " 1")
    assert P.propose("x" * 300_000) == [] and len(P.propose("token=" * 50_000 + "1")) == 2


class Sure:
    def probabilities(self, x):
        return np.ones(len(x))


def test_the_rest_of_a_secret_around_a_fixed_span_is_kept():
    text = "secret=abcdefgh4111111111111111ijklmnop end"
    base, spans = P.all_spans(text, Sure(), 0.9)
    assert base == [(15, 31, "card")]
    assert {(0, 15, "secret"), (31, 39, "secret")} <= set(spans)
    assert list(P.uncovered(0, 10, [(2, 4), (3, 5), (9, 12)])) == [(0, 2), (5, 9)]


def test_long_secrets_are_redacted(spark):
    draw = np.random.default_rng(9)
    key = "".join(draw.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 1600))
    plain = "der and the erheit von in thonder " * 20
    docs = docs_of(spark, [(i, plain) for i in range(100)] + [(200, f"{plain}{key} more"), (201, f"{plain}password={key} more")])
    hidden = {r["doc_id"]: r["text"] for r in P.redact(docs).where("doc_id >= 200").collect()}
    assert all(h == f"{plain}<secret> more" for h in hidden.values()) and len(hidden) == 2


def test_thousands_of_leading_zeros():
    text = "0" * 5000 + "1.2.3.4"
    assert P.base_spans(text) == [(0, len(text), "ip")]
    assert P.base_spans("0" * 5000 + "256.2.3.4") == []
    assert P.base_spans("0.0.0.000") == [(0, 9, "ip")]


def test_plants_stand_anywhere_with_their_white_space():
    text = "".join(f"w{i}\n\t" for i in range(5000))
    seen = set()
    for seed in range(20):
        made, where = P.planted(text, seed)
        assert "\n\t" in made and all(made[a:b].strip() for a, b, _ in where)
        seen |= {int(w) for w in re.findall(r"w(\d{1,4})\n\t", made)}
    assert max(seen) > 2500
    assert len(re.findall(r"w\d+\n\t", P.planted(text, 1, words=60)[0])) == 60
    assert P.planted("", 1)[1] and P.planted("one", 1)[0].count("one") >= 1
