"""Personal data: fixed patterns, and boosted trees over the spans that loose generators propose.

There are no labelled spans in the tables, so the trees learn from planted ones: into a bounded sample of documents
(SAMPLE_DOCS, drawn by a hash of the id) seeded generators write personal data and look-alikes, the proposals are
labelled by what was planted, and Spark's gradient-boosted trees are fitted to them. Every fourth sampled document is
held back for calibration. Finding spans is one map over Arrow batches of all documents and whole texts; no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.grams import slices
from tickloom.llm.quality import calibrate
from tickloom.llm.text import or_empty, table
from tickloom.session import cut_lineage

SAMPLE_DOCS = 400
#: Words of each sampled document that the plants stand between; the stretch is drawn from anywhere in the text.
TRAIN_WORDS = 480
CONTEXT = 24

#: The kinds and patterns of the contract. The email's local part is found from its @ leftwards, and the
#: ip pattern starts at the first digit of a run, so that no text takes quadratic time; the matches are the same.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """The check-digit rule of card numbers."""
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


_ANY_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[Span]:
    """The contract's spans, by start and then kind."""
    found: list[Span] = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _ANY_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: High-recall generators: kind of the span they propose, what a text must contain, pattern. They may overlap. Runs
#: without a length of their own are possessive and unbounded, so that a long one is proposed whole in linear time.
GENERATORS: tuple[tuple[str, str, re.Pattern], ...] = (
    ("email", "", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)+")),
    ("phone", "0", re.compile(r"(?<![0-9A-Za-z])(?:\+|\()?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])")),
    ("card", "0", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9A-Za-z])")),
    ("ip", "0", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9A-Za-z])")),
    ("secret", "", re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}+")),
    ("secret", "0", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+")),
)
ALL_KINDS = KINDS + ("secret",)
_WORTH = re.compile(r"[0-9@=:]|\(at\)|\[at\]")
_CUES = tuple(re.compile(p, re.I) for p in (r"mail|contact|write", r"phone|tel|call|mobile|fax", r"card|visa|pay|credit", r"passw|token|secret|key|pwd", r"order|invoice|isbn|version|page|no\.|#|\$"))


def propose(text: str) -> list[Span]:
    if not _WORTH.search(text):
        return []
    digit = bool(_ANY_DIGIT.search(text))
    return [(m.start(), m.end(), kind) for kind, needs, p in GENERATORS if digit or not needs for m in p.finditer(text)]


def features(text: str, span: Span) -> list[float]:
    """Format of the span and cues around it."""
    a, b, kind = span
    s, before = text[a:b], text[max(0, a - CONTEXT) : a]
    digits = _digits(s)
    lower, upper = sum(c.islower() for c in s), sum(c.isupper() for c in s)
    kinds = "".join("d" if c.isdigit() else "l" if c.isalpha() else "s" for c in s)
    near = text[b : b + 1]
    return [
        float(ALL_KINDS.index(kind)),
        float(len(s)),
        float(len(digits)),
        float(lower),
        float(upper),
        float(len(s) - len(digits) - lower - upper),
        float(sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))),
        float(len(set(s))) / len(s),
        float(s[:1] == "+"),
        float("@" in s or "(at)" in s or "[at]" in s),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        float(kind == "ip" and all(int(p) <= 255 for p in s.split("."))),
        float("(" in s),
        float(s.count("-")),
        float("=" in s or ":" in s),
        float(bool(re.match(r"(?:19|20)[0-9]{2}[-./ ]?[01][0-9]", s))),
        float(len(max(re.split("[^0-9]", s), key=len))),
        float(not near or near.isspace() or near in ".,;)\"'"),
        *(float(bool(c.search(before))) for c in _CUES),
    ]


class Trees(NamedTuple):
    """The fitted ensemble as node arrays; a leaf points to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int
    slope: float
    offset: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root, w in zip(self.roots, self.weights, strict=True):
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            total += w * self.value[node]
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x) + self.offset, -30, 30)))


def node_arrays(described: str, depth: int) -> Trees:
    """The trees as Spark's model describes them, in arrays."""
    feature, limit, left, right, value, roots, weights = [], [], [], [], [], [], []
    lines = [x.strip() for x in described.splitlines()]

    def node(at: int) -> tuple[int, int]:
        me = len(feature)
        for column, v in ((feature, 0), (limit, np.inf), (left, me), (right, me), (value, 0.0)):
            column.append(v)
        if m := re.match(r"Predict: (\S+)", lines[at]):
            value[me] = float(m[1])
            return me, at + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        feature[me], limit[me] = int(m[1]), float(m[2])
        left[me], at = node(at + 1)
        right[me], at = node(at + 1)  # the line at `at` is the Else of this If
        return me, at

    for i, line in enumerate(lines):
        if m := re.match(r"Tree \d+ \(weight (\S+)\)", line):
            weights.append(float(m[1]))
            roots.append(node(i + 1)[0])
    return Trees(*(np.array(v) for v in (feature, limit, left, right, value, roots, weights)), depth, 1.0, 0.0)


def _plants(rng: np.random.Generator) -> tuple[str, bool]:
    """A string to plant, and whether it is personal data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    x = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    up = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), n))
    b64 = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), n))
    card = lambda: next(c for c in (body + str(k) for body in [str(rng.integers(3, 7)) + d(14)] for k in range(10)) if luhn(c))
    four = lambda c, sep: sep.join(c[i : i + 4] for i in range(0, 16, 4))
    real: tuple[Callable[[], str], ...] = (
        lambda: f"{w(5)}.{d(2)}@{w(6)}.com",
        lambda: f"{w(6)} (at) {w(7)} (dot) org",
        lambda: f"{w(4)}[at]{w(6)}.net",
        lambda: f"+{rng.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}",
        lambda: f"({d(3)}) {d(3)}-{d(4)}",
        lambda: f"call {d(3)}-{d(3)}-{d(4)}",
        lambda: f"tel. {d(3)} {d(3)} {d(4)}",
        lambda: card(),
        lambda: four(card(), rng.choice([" ", "-"])),
        lambda: ".".join(str(v) for v in rng.integers(1, 256, 4)),
        lambda: f"password={x(18)}",
        lambda: f'token = "{x(40)}"',
        lambda: f"api_key: {up(24)}",
        lambda: f"AKIA{up(16)}",
        lambda: f"secret={w(4)}{d(6)}",
        lambda: b64(int(rng.integers(100, 2000))),
        lambda: f"token={b64(int(rng.integers(100, 2000)))}",
    )
    alike: tuple[Callable[[], str], ...] = (
        lambda: f"order {d(9)}",
        lambda: f"invoice no. {d(8)}",
        lambda: f"{rng.integers(1950, 2030)}-0{rng.integers(1, 9)}-1{d(1)}",
        lambda: f"0{rng.integers(1, 9)}.0{rng.integers(1, 9)}.{rng.integers(1950, 2030)} {d(2)}:{d(2)}",
        lambda: f"${d(3)},{d(3)}.{d(2)} of {d(7)}",
        lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: next(c for c in iter(lambda: "9" + d(15), None) if not luhn(c)),
        lambda: f"version {rng.integers(300, 999)}.{d(1)}.{d(3)}.{d(2)}",
        lambda: f"{w(8)}_{w(9)}_{d(1)}",
        lambda: f"https://{w(6)}.com/{w(5)}/{w(9)}-{d(2)}-{w(5)}",
        lambda: f"{w(7)} at {w(7)}: {w(5)}",
        lambda: f"page {d(3)} {d(3)} {d(3)} {d(3)}",
        lambda: f"token: {w(5)} {w(4)}",
        lambda: f"{d(1)}.{d(6)}{d(6)}",
        lambda: f"{w(12)}-{w(4)}{d(1)}-{w(6)}",
        lambda: "/".join(w(int(k)) for k in rng.integers(3, 9, rng.integers(20, 200))) + f"/{d(2)}",
        lambda: "-" * int(rng.integers(60, 400)) + d(1),
    )
    good = bool(rng.integers(0, 2))
    chosen = real if good else alike
    return chosen[int(rng.integers(0, len(chosen)))](), good


_WORDS = re.compile(r"\S+\s*")


def planted(text: str, seed: int, n: int = 12, words: int = TRAIN_WORDS) -> tuple[str, list[tuple[int, int, bool]]]:
    """A stretch of so many words from anywhere in a text, with strings planted between them, and where those stand."""
    rng = np.random.Generator(np.random.PCG64(seed))
    ends = [0, *(m.end() for m in _WORDS.finditer(text))]
    first = int(rng.integers(0, max(1, len(ends) - words)))
    ends = ends[first : first + words + 1]
    out, where, at = [], [], 0
    for i in range(n):
        lead = text[ends[i * (len(ends) - 1) // n] : ends[(i + 1) * (len(ends) - 1) // n]]
        lead += " " if lead and not lead[-1].isspace() else ""
        s, good = _plants(rng)
        where.append((at + len(lead), at + len(lead) + len(s), good))
        out.append(lead + s + rng.choice([" ", ". ", ", "]))
        at += len(out[-1])
    return "".join(out), where


def _examples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for seed, fold, text in zip(frame["seed"], frame["fold"], frame["text"], strict=True):
            made, where = planted(text, int(seed) & 0x7FFFFFFF)
            for span in propose(made):
                inside = [g for a, b, g in where if span[0] < b and a < span[1]]
                if inside:
                    rows.append((float(inside[0]), bool(fold == 0), features(made, span)))
        yield pd.DataFrame(rows, columns=["label", "held", "x"])


def train(docs: DataFrame, sample: int = SAMPLE_DOCS, rounds: int = 12, depth: int = 4) -> Trees | None:
    """The fitted trees; None for a table without documents."""
    seed = F.xxhash64("doc_id")
    ids = cut_lineage(docs.select(seed.alias("seed")).distinct().orderBy("seed").limit(sample))  # at most `sample` numbers
    again = F.sequence(F.lit(1), F.lit(-(-sample // max(1, ids.count()))))  # few documents carry more plants each
    drawn = docs.select(seed.alias("seed"), or_empty("text").alias("text")).join(F.broadcast(ids), "seed")
    drawn = drawn.withColumn("n", F.explode(again)).select(F.xxhash64("seed", "n").alias("seed"), "text")
    drawn = drawn.withColumn("fold", F.pmod("seed", F.lit(4)))
    rows = cut_lineage(drawn.mapInPandas(_examples, "label double, held boolean, x array<double>"))
    vectors = rows.select("label", "held", array_to_vector("x").alias("features"))
    counts = {bool(r["held"]): r["n"] for r in rows.groupBy("held").agg(F.count_distinct("label").alias("n")).collect()}
    if counts.get(False, 0) < 2:
        return None
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=11).fit(vectors.where("not held"))
    trees = node_arrays(model.toDebugString, depth)
    held = rows.where("held").toPandas()  # a quarter of the bounded sample
    if not len(held):
        return trees
    slope, offset = calibrate(trees.margins(np.array(held["x"].tolist())), held["label"].to_numpy())
    return trees._replace(slope=slope, offset=offset)


def uncovered(a: int, b: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches of a:b outside of all taken ones."""
    for x, y in sorted(t for t in taken if t[0] < b and a < t[1]):
        if a < x:
            yield a, x
        a = max(a, y)
    if a < b:
        yield a, b


def all_spans(text: str, trees: Trees | None, keep_from: float) -> tuple[list[Span], list[Span]]:
    """The fixed spans, and all spans: those and what the proposals that the trees select have outside of them.

    The surest proposal comes first; one that meets a taken span adds only its rest, if a letter or digit is in it.
    """
    base = base_spans(text)
    if trees is None or not (found := propose(text)):
        return base, base
    p = trees.probabilities(np.array([features(text, s) for s in found]))
    taken = [s[:2] for s in base]
    added: list[Span] = []
    for i in np.argsort(-p, kind="stable"):
        if p[i] >= keep_from:
            a, b, kind = found[i]
            rest = [(x, y) for x, y in uncovered(a, b, taken) if any(map(str.isalnum, text[x:y]))]
            taken += rest
            added += [(x, y, kind) for x, y in rest]
    return base, sorted(base + added, key=lambda s: (s[0], ALL_KINDS.index(s[2])))


def spell(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, keep_from: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per input row.

    Offsets count code points, ends exclusive. A null text is empty and has no spans. Rows that repeat an id are
    searched one by one. An empty table gives an empty result; other columns are ignored.
    """
    trees = train(docs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                rows = [all_spans(v or "", trees, keep_from) for v in part["text"].to_pylist()]
                n = [pa.array([sum(s[2] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
                sha = pa.array([hashlib.sha256(spell(base).encode()).hexdigest() for base, _ in rows], pa.string())
                spans = pa.array([spell(every) for _, every in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], *n, sha, spans], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, SCHEMA)


def redact(docs: DataFrame, keep_from: float = 0.9) -> DataFrame:
    """The documents, all columns, with every span replaced by its kind in angle brackets."""
    trees, at = train(docs), docs.columns.index("text")

    def hide(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for a, b, kind in all_spans(text, trees, keep_from)[1]:
            if a >= done:
                out += [text[done:a], f"<{kind}>"]
            done = max(done, b)
        return "".join(out) + text[done:]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                texts = pa.array([hide(v) for v in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), texts)

    return docs.mapInArrow(rewrite, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
