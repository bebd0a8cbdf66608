import itertools
import math

from pyspark.sql import functions as F

from tickloom.llm import url_rules as U


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")


LABELS = "doc_id long, quality int, toxic int"


def test_hosts_paths_and_listed_rules(spark):
    cases = {
        "http://A.Example.ORG/es/1?q#f": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/fr/a": ("x.com", "/fr/a", "com/fr/", "allow"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://x.org?a/b": ("x.org", "", None, "allow"),
        "http://ÀB.org/É#x": ("Àb.org", "/É", "org/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    df = pages(spark, [*cases, None]).withColumn("host", F.lit("clash"))
    got = U.judge(df, spark.createDataFrame([], LABELS)).collect()
    by_id = {r["page_id"]: tuple(r)[1:5] for r in got}
    assert by_id == {i: v for i, v in enumerate([*cases.values(), ("", "", None, "allow")])}


def planted(spark):
    urls, labels = [], []
    for i in range(400):
        pills, cheap = i % 4 == 0, i % 3 == 0
        urls.append(f"http://{'pills' if pills else 'shop'}.{'cheap' if cheap else 'good'}.net/p{i}/item?ref=x")
        labels.append((i, int(not (pills and cheap)), int(i % 97 == 0)))
    return pages(spark, urls), spark.createDataFrame(labels, LABELS)


def test_combinations_are_mined_and_matched(spark):
    p, labels = planted(spark)
    rules = U.mine_rules(p, labels.union(labels)).collect()
    assert ["h:cheap", "h:pills"] in [r["tokens"] for r in rules]
    assert all(r["confidence"] >= 0.6 for r in rules)
    got = {r["page_id"]: r["verdict"] for r in U.judge(p, labels).collect()}
    assert all((got[i] == "block") == (i % 12 == 0) for i in range(400) if i % 97)


def test_matching_equals_brute_force(spark):
    p, labels = planted(spark)
    rules = [(set(r["tokens"]), r["confidence"]) for r in U.mine_rules(p, labels).collect()]
    tokens = {r["page_id"]: set(r["t"]) for r in p.select("page_id", U.url_tokens(F.col("url")).alias("t")).collect()}
    want = {i: max(c for need, c in rules if need <= t) for i, t in tokens.items() if any(need <= t for need, _ in rules)}
    got = {r["page_id"]: r["confidence"] for r in U.judge(p, labels).where("confidence IS NOT NULL").collect()}
    assert got == want and got


def test_long_repeated_url_does_not_blow_up(spark):
    long = "http://h.net/" + "/".join(f"w{k}" for k in range(300))
    p = pages(spark, [long] * 20 + [f"http://o.net/{k}" for k in range(20)])
    labels = spark.createDataFrame([(i, int(i >= 20), 0) for i in range(40)], LABELS)
    assert U.mine_rules(p, labels).count() >= 1


def test_empty(spark):
    assert U.judge(pages(spark, []).where("false"), spark.createDataFrame([], LABELS)).count() == 0


def test_chance_mines_nothing(spark):
    """Labels that do not depend on the URL: small counts of bad pages make no rule."""
    urls = [f"http://h{i * 7 % 90}.net/a{i * 11 % 130}/b{i * 13 % 170}" for i in range(900)]
    labels = spark.createDataFrame([(i, int(i * 7919 % 1009 % 4 > 0), 0) for i in range(900)], LABELS)
    assert U.mine_rules(pages(spark, urls), labels).count() == 0


def test_a_bad_host_is_mined_at_any_size(spark):
    """30 bad pages of one host, among 300 and among 30,000 labelled pages."""
    for n in (300, 30_000):
        urls = [f"http://{'pills' if i < 30 else f'h{i % 97}'}.net/p{i}" for i in range(n)]
        labels = spark.createDataFrame([(i, int(i >= 30), 0) for i in range(n)], LABELS)
        assert [(r["tokens"], r["confidence"]) for r in U.mine_rules(pages(spark, urls), labels).collect()] == [(["h:pills"], 1.0)]


def test_mining_equals_brute_force(spark):
    """Rules of the planted pages, by counting all sets of the tokens that stand on enough bad pages."""
    p, labels = planted(spark)
    bad = {r["doc_id"]: r["quality"] == 0 or r["toxic"] == 1 for r in labels.collect()}
    tokens = {r["page_id"]: set(r["t"]) for r in p.select("page_id", U.url_tokens(F.col("url")).alias("t")).collect()}
    where: dict[frozenset, list[str]] = {}
    for t in set().union(*tokens.values()):
        on = frozenset(i for i, x in tokens.items() if t in x)
        if sum(bad[i] for i in on) >= U.MIN_BAD:
            where.setdefault(on, []).append(t)
    items, base, found = {min(v): on for on, v in where.items()}, sum(bad.values()) / len(bad), {}
    for size in range(1, len(items) + 1):
        for chosen in itertools.combinations(sorted(items), size):
            on = frozenset.intersection(*(items[t] for t in chosen))
            hits = sum(bad[i] for i in on)
            if hits < U.MIN_BAD or hits / len(on) < max(0.6, 1.5 * base):
                continue
            share, n, z = hits / len(on), len(on), U.Z
            low = (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if low > base:
                found[chosen] = share
    want = {k: v for k, v in found.items() if not any(set(x) < set(k) and c >= v for x, c in found.items())}
    got = {tuple(r["tokens"]): r["confidence"] for r in U.mine_rules(p, labels).collect()}
    assert got == want and got


def test_planted_combination_among_64000_pages(spark):
    """A bad combination is mined from the sample too, and all pages that hold it are blocked."""
    n = 64_000
    url = F.concat(
        F.lit("http://h"), F.col("id") % 89, F.when(F.col("id") % 40 == 0, ".pills").otherwise(".shop"),
        F.when(F.col("id") % 3 == 0, ".cheap").otherwise(".good"), F.lit(".net/p"), F.col("id"),
    )
    rows = spark.range(n).select(F.col("id").alias("page_id"), url.alias("url"), F.lit("").alias("html"))
    spam = (F.col("id") % 120 == 0).cast("int")
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (1 - spam).alias("quality"), F.lit(0).alias("toxic"))
    for most in (U.MOST_LABELLED, 16_000):
        rules = U.mine_rules(rows, labels, most_labelled=most)
        assert [r["tokens"] for r in rules.collect()] == [["h:cheap", "h:pills"]]
        blocked = {r["page_id"] for r in U.judge(rows, labels, most_labelled=most).where("verdict = 'block'").collect()}
        assert blocked == set(range(0, n, 120))


def test_very_long_url_and_equal_confidence(spark):
    long = "http://h.net/" + "a/" * 500_000
    got = U.judge(pages(spark, [long, None, long]), spark.createDataFrame([], LABELS)).collect()
    assert sorted((r["page_id"], len(r["path"])) for r in got) == [(0, 1_000_001), (1, 0), (2, 1_000_001)]
    urls = [f"http://{'pills' if i % 2 else 'casino'}.net/p{i}" if i < 60 else f"http://ok{i}.net/" for i in range(300)]
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(300)], LABELS)
    assert sorted(r["tokens"] for r in U.mine_rules(pages(spark, urls), labels).collect()) == [["h:casino"], ["h:pills"]]
