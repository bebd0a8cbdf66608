import random
from difflib import SequenceMatcher
from itertools import combinations

from tests.llm.helpers import docs_of
from tickloom.llm import licenses as L

WORDS = {n: L.words_of(t)[0] for n, t in L.TEMPLATES.items()}


def test_rising_is_longest():
    draw = random.Random(1)
    for _ in range(200):
        v = [draw.randrange(12) for _ in range(draw.randrange(10))]
        best = max(len(c) for n in range(len(v) + 1) for c in combinations(v, n) if all(a < b for a, b in zip(c, c[1:], strict=False)))
        got = [v[i] for i in L.rising(v)]
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:], strict=False))


def test_alignment_is_a_common_subsequence():
    draw = random.Random(2)
    t = WORDS["mit"]
    for _ in range(50):
        text = [w for w in t if draw.random() > 0.1]
        for _ in range(draw.randrange(30)):
            text.insert(draw.randrange(len(text)), draw.choice(["foo", "bar", "the"]))
        pairs = L.align(text, t)
        assert all(text[i] == t[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        blocks = sum(m.size for m in SequenceMatcher(None, text, t, autojunk=False).get_matching_blocks())
        assert len(pairs) >= 0.95 * blocks


def test_scan(spark):
    noise = "mit der und license the of under version software copyright " * 40
    mit = L.TEMPLATES["mit"].replace("merge, ", "").replace("sublicense, ", "")
    rows = [
        (1, f"Erheit.\nReleased under the MIT License.\n{noise}"),
        (2, noise + mit + noise),
        (3, noise),
        (4, None),
        (5, ""),
        (6, "Licensed under CC BY-NC 4.0. Also licensed UNDER the apache LICENSE, version 2.0!"),
        (6, "plain"),
        (7, "long " * 60000 + "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = [(r["doc_id"], r["license"], r["licenses"]) for r in L.scan_documents(docs_of(spark, rows)).collect()]
    by = {(i, lic) for i, lic, _ in got}
    assert by == {(1, "mit-notice"), (2, "mit"), (3, None), (4, None), (5, None), (6, "apache-2.0-notice"), (6, None), (7, "gpl-notice")}
    start = {r["doc_id"]: (r["start"], r["end"]) for r in L.scan_documents(docs_of(spark, rows[:1])).collect()}[1]
    assert rows[0][1][slice(*start)] == "Released under the MIT License"
    assert L.scan_documents(docs_of(spark, [])).count() == 0


def test_cue_words_lose_nothing():
    """Whatever covers a template holds one of its cue words: dropping all of them drops below the coverage."""
    for t in WORDS.values():
        cues = L.cue_words(t, {w: -len(w) for w in t}, 0.8)
        assert sum(w not in cues for w in t) / len(t) < 0.8


def places_of(text):
    return [(n, text[a:b]) for n, _, a, b in L.scan(text, WORDS, L.COVERAGE)]


def test_repeated_licenses_are_all_found():
    notice, mit = L.TEMPLATES["mit-notice"], L.TEMPLATES["mit"].rstrip(".")
    assert places_of(f"Foo bar. {notice}. Some text here. {notice}. More text") == [("mit-notice", notice)] * 2
    assert places_of(f"{notice}. " * 5) == [("mit-notice", notice)] * 5
    assert places_of(f"{mit}\n\nint main() {{}}\n\n{mit} {mit}") == [("mit", mit)] * 3
    cut = mit.replace("merge, ", "")
    assert [t for _, t in places_of(f"{cut} x {mit} y {cut}")] == [cut, mit, cut]
    assert all(s == 1 for _, s, _, _ in L.scan(f"{mit}\n{mit}", WORDS, L.COVERAGE))


def test_nested_licenses_are_found():
    isc, notice = L.TEMPLATES["isc"].rstrip("."), L.TEMPLATES["mit-notice"]
    a, b = isc[: isc.index("hereby")], isc[isc.index("hereby") :]
    got = places_of(f"{notice}. {a}{notice} {b} {isc}")
    assert got == [("isc", f"{a}{notice} {b}"), ("isc", isc), ("mit-notice", notice), ("mit-notice", notice)]


def test_steps_are_longest_alignments():
    draw = random.Random(3)
    for _ in range(300):
        text, t = ([draw.choice("abcd") for _ in range(draw.randrange(1, 12))] for _ in range(2))
        best = [[0] * (len(t) + 1)]
        for w in text:
            row = [0]
            for j, v in enumerate(t):
                row.append(best[-1][j] + 1 if v == w else max(row[j], best[-1][j + 1]))
            best.append(row)
        tpl = L.Template(t, 0.8)
        got = [k for _, k in L.steps(text, range(len(text)), tpl.ahead, len(t))]
        assert max(got, default=0) == best[-1][-1] == len(L.align_gap(text, t))


def names_of(text):
    return {n for n, *_ in L.scan(text, WORDS, L.COVERAGE)}


def test_only_the_named_license_is_reported(spark):
    texts = {
        "Released under the BSD License": "bsd-notice",
        "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0-notice",
        "Licensed under CC BY 4.0": "cc-by-4.0-notice",
        "Licensed under CC BY-NC-ND 4.0": None,
        "Released under CC0 1.0": "cc0-1.0-notice",
        "The record was released in May under a label with the usual license of that time": None,
        "This work is licensed under the GNU General Public License, version 2": "gpl-2.0-notice",
        "This work is licensed under the GNU General Public License, version 3.0": "gpl-notice",
        "This work is licensed under the GNU Lesser General Public License, version 3": "lgpl-3.0-notice",
        "This work is licensed under the GNU Affero General Public License, version 3": None,
        "This work is licensed under version 3 of the GNU General Public License": "gpl-unversioned-notice",
        "Licensed under CC BY-NC 3.0": "cc-by-nc-unversioned-notice",
        "Licensed under contract by 4 companies": None,
        "Licensed under the Apache License 2.0": "apache-2.0-notice",
        "Licensed under the Apache License, Version 1.1": None,
        "Licensed under the MIT License": "mit-notice",
        "released under " + "word " * 9 + "the MIT License": None,
    }
    got = L.scan_documents(docs_of(spark, list(enumerate(texts)))).collect()
    assert {list(texts)[r["doc_id"]]: r["license"] for r in got} == texts


def test_each_template_is_its_own(spark):
    """A template's text is found as that template and as nothing else."""
    got = L.scan_documents(docs_of(spark, list(enumerate(L.TEMPLATES.values())))).collect()
    assert {list(L.TEMPLATES)[r["doc_id"]]: (r["license"], r["coverage"], r["licenses"].count(",")) for r in got} == {n: (n, 1.0, 0) for n in L.TEMPLATES}


def test_two_licenses_of_one_sentence():
    assert names_of("Licensed under the MIT License or the Apache License, Version 2.0") == {"mit-notice", "apache-2.0-notice"}
    assert names_of("Released under the BSD License. Released under the MIT License.") == {"bsd-notice", "mit-notice"}
