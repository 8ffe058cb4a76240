import random
from itertools import combinations, permutations

from hypothesis import given, settings, strategies as st

from tersus.llm import license_scan as scan
from tersus.llm.suite import QUERIES

SF = "/root/testdata/sf0.01"


def test_longest_increasing_equals_full_search():
    r = random.Random(1)
    for _ in range(60):
        pairs = list(enumerate(r.sample(range(30), r.randint(0, 9))))
        best = max((len(c) for n in range(len(pairs) + 1) for c in combinations(pairs, n)
                    if all(a[1] < b[1] for a, b in zip(c, c[1:]))), default=0)
        found = scan.longest_increasing(pairs)
        assert len(found) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=14), st.lists(st.sampled_from("abcdefg"), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = scan.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if len(set(a)) == len(a) and sorted(a) == sorted(b):  # all words are anchors: it is a longest one
        place = {w: j for j, w in enumerate(b)}
        assert len(pairs) == len(scan.longest_increasing([(i, place[w]) for i, w in enumerate(a)]))
    assert scan.patience(a, a) == [(i, i) for i in range(len(a))]


def found(text, **kw):
    cut = {n: scan.words_of(t) for n, t in (kw.get("templates") or scan.TEMPLATES).items()}
    return {n: m for n, m in scan.scan_text(text, cut, {w for t in cut.values() for w in t}, 0.8)}


def test_every_template_is_found_in_context():
    r = random.Random(4)
    for name, template in scan.TEMPLATES.items():
        noise = [r.choice(["the", "license", "a", "of", "software", "x%d" % i]) for i in range(3000)]
        words = scan.words_of(template)
        text = " ".join(noise[:1700] + words + noise[1700:])
        m = found(text)[name]
        assert (m.matched, m.first_word, m.last_word) == (len(words), 1700, 1699 + len(words))
        if len(words) >= 10:  # one word in ten changed
            changed = [w if i % 10 != 5 else f"zz{i}" for i, w in enumerate(words)]
            assert found(" ".join(noise + changed))[name].matched >= 0.8 * len(words)
            assert name not in found(" ".join(noise + words[:len(words) // 2]))


def test_neighbouring_licenses_are_not_taken_for_a_template():
    for text, name in [("Released under the BSD License.", "MIT-line"), ("Released under the Apache License.", "MIT-line"),
                       ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-4.0-line"), ("Licensed under CC BY-ND 4.0.", "CC-BY-4.0-line"),
                       ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-SA-4.0-line"), ("Licensed under the Apache License, Version 1.1.", "Apache-2.0-line"),
                       ("This work is licensed under the GNU General Public License, version 2.", "GPL-3.0-line"),
                       ("This work is licensed under the GNU Lesser General Public License, version 3.", "GPL-3.0-line"),
                       (scan.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"), "GPL-3.0-header"),
                       (scan.TEMPLATES["GPL-3.0-header"].replace("GNU\n        General", "GNU Lesser General"), "GPL-3.0-header"),
                       (scan.TEMPLATES["GPL-3.0-header"].replace("GNU\n        General", "GNU Affero General"), "GPL-3.0-header")]:
        assert name not in found(text), text
    assert set(found("Released under the terms of the MIT License.")) == {"MIT-line"}


def test_each_template_is_reported_as_itself_only():
    for name, template in scan.TEMPLATES.items():
        assert {n: m.matched for n, m in found(template).items()} == {name: len(scan.words_of(template))}
    assert {"BSD-3-Clause", "GPL-2.0-header", "AGPL-3.0-header", "LGPL-3.0-header", "LGPL-2.1-header", "MPL-2.0-header"} <= set(scan.TEMPLATES)
    assert "shall the authors or copyright holders be liable" in " ".join(scan.words_of(scan.TEMPLATES["MIT"]))
    grant = scan.TEMPLATES["MIT"][:scan.TEMPLATES["MIT"].index("THE SOFTWARE IS")]
    assert "MIT" not in found(grant)  # the license without its disclaimer is not whole


NAMES = [n for n in scan.TEMPLATES if not n.startswith("CC-")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(NAMES + ["CC-BY-4.0-line", "CC-BY-SA-4.0-line"]), min_size=2, max_size=4, unique=True), st.integers(0, 1000))
def test_licenses_are_found_in_every_order(names, seed):
    r = random.Random(seed)
    for order in permutations(names):
        text = " ".join(" ".join([scan.TEMPLATES[n], *(f"x{r.randrange(99)}" for _ in range(r.choice([40, 400])))]) for n in order)
        assert set(found(text)) == set(names)


def test_a_license_inside_another_does_not_hide_its_own_text():
    filler = " ".join(f"x{i}" for i in range(400))
    for a, b in [("BSD-3-Clause", "BSD-2-Clause"), ("Apache-2.0-header", "Apache-2.0-line")]:
        for first, second in ((a, b), (b, a)):
            got = found(f"{scan.TEMPLATES[first]} {filler} {scan.TEMPLATES[second]}")
            assert {n: m.matched for n, m in got.items()} == {n: len(scan.words_of(scan.TEMPLATES[n])) for n in (a, b)}
    assert found("Released under the MIT License. " * 7)["MIT-line"].passages == 7


def plain_scan(words, templates, least):
    """Every window of every length that a passage may have, then the same rule for overlaps."""
    every = []
    for name, t in templates.items():
        need, slack = (least if len(t) >= scan.SHORT else 1.0) * len(t) - 1e-9, max(4, len(t) // 4)
        for a in range(-slack, len(words)):
            pairs = scan.patience(t, words[max(0, a):a + len(t) + 2 * slack])
            if len(pairs) >= need:
                every.append((name, scan.Match(len(pairs), max(0, a) + pairs[0][1], max(0, a) + pairs[-1][1])))
    taken = []
    for name, m in sorted(every, key=lambda x: (-x[1].matched, -x[1].matched / len(templates[x[0]]), x[0], x[1].first_word)):
        if all(m.last_word < o.first_word or m.first_word > o.last_word for _, o in taken):
            taken.append((name, m))
    return {name: max(m.matched for n, m in taken if n == name) for name, _ in taken}


def test_scan_equals_a_search_of_all_windows():
    r = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    for _ in range(25):
        templates = {f"t{k}": r.sample(words, r.choice([5, 12, 20])) for k in range(3)}
        text = []
        for _ in range(r.randint(2, 4)):
            t = list(r.choice(list(templates.values())))
            for _ in range(r.randint(0, 2)):
                t.insert(r.randrange(len(t)), "y") if r.random() < 0.5 else t.pop(r.randrange(len(t)))
            text += t + [f"x{i}" for i in range(r.randint(25, 40))]
        got = scan.scan_text(" ".join(text), templates, set(words), 0.8, {})
        assert {n: m.matched for n, m in got} == plain_scan(text, templates, 0.8)


def test_phrases_are_of_the_own_templates_only(spark):
    df = spark.createDataFrame([(1, "released under some mit terms here")], "doc_id long, text string")
    own = {"MIT-line": "released under some mit terms"}
    assert scan.scan_licenses(df, templates=own).count() == 1
    assert scan.scan_licenses(df, templates=own, phrases={"MIT-line": ("mit license",)}).count() == 0


def test_table_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "Released under the MIT License. " * 3), (1, "Released under the MIT License. " * 3), (2, None), (3, ""),
            (None, "licensed under cc by-nc 4.0"), (5, "mit license released the under"), (6, "the " * 50_000 + "Released under the MIT License.")]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, license string, coverage double")
    got = sorted((str(r["doc_id"]), r["license"], r["coverage"], r["first_word"]) for r in scan.scan_licenses(df).collect())
    assert got == sorted([("1", "MIT-line", 1.0, 0), ("1", "MIT-line", 1.0, 0), ("None", "CC-BY-NC-4.0-line", 1.0, 0), ("6", "MIT-line", 1.0, 50_000)])
    assert scan.scan_licenses(df.limit(0)).count() == 0 and scan.scan_licenses(df, templates={}).count() == 0


def test_query_finds_all_planted_lines(spark):
    got = {(r["doc_id"], r["license"]) for r in QUERIES["op3_license_scan"](spark, SF).collect()}
    lines = {n: t for n, t in scan.TEMPLATES.items() if n.endswith("-line")}
    planted = {(r["doc_id"], n) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for n, t in lines.items() if t in (r["text"] or "")}
    assert planted and planted == got
