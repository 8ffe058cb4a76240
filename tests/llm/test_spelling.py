import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from tersus.llm import spelling
from tersus.llm.suite import QUERIES

SF = "/root/testdata/sf0.001"


def plain_words(docs, least_length=7, least_count=2):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def plain_variants(n, ratio=10):
    """By the words that one deletion gives: two of them meet there with the same place, or one is the other's."""
    gone = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gone[w[:i] + w[i + 1:]].add((w, i))
    near = defaultdict(set)
    for short, those in gone.items():
        for a, i in those:
            if short in n:
                near[a].add(short)
                near[short].add(a)
            near[a].update(b for b, j in those if i == j and b != a)
    out = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        out[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if out[w] is None else root(out[w])
    return {(w, f, root(w), n[w], len(near[w]), n[f] if f else None) for w, f in out.items()}


def as_set(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_words(seed, size, letters="abzé", lengths=(1, 9)):
    r, n = random.Random(seed), {}
    for _ in range(size):
        w = "".join(r.choice(letters) for _ in range(r.randint(*lengths)))
        n[w] = r.choice([2, 3, 20, 30, 250, 4000])
    return n


@pytest.mark.parametrize("symbols", [None, 1, 2, 3, 20])
def test_variants_equal_plain_version_for_any_alphabet(spark, symbols):
    n = some_words(1, 300)
    got = spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"), symbols=symbols)
    assert as_set(got) == plain_variants(n)


def test_long_words_meet_short_ones(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CARRIED", 4)
    monkeypatch.setattr(spelling, "GENERATED", 64)
    n = some_words(2, 200, "ab", (2, 8))
    got = spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"), symbols=2)
    assert as_set(got) == plain_variants(n)


def test_runs_of_many_thousand_letters(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh") for _ in range(60_000))
    n = {long: 500, long[:30_000] + long[30_001:]: 50, long[:-1] + "ÿ": 4, long[:100] + "q" + long[100:]: 3, "x" * 64: 30, "x" * 65: 3}
    assert as_set(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_variants(n)


def test_chains_of_forms_and_ties(spark):
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 20000, "tyingaa": 3, "tyingab": 40, "tyingac": 40}
    got = {r["word"]: (r["form"], r["root"]) for r in
           spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij")
    assert got["tyingaa"] == ("tyingab", "tyingab")
    assert got["tyingab"] == (None, "tyingab")


DOCS = [(1, "Orations orations ORATIONS orationÉ naïveté naïveté ×××××××"), (2, None), (3, ""), (None, "orations nullids nullids"),
        (1, "Orations orations ORATIONS orationÉ naïveté naïveté ×××××××"), (4, "short words 1234567 snake_casewords"),
        (5, "orationz " * 90 + "z" * 5000 + " " + "z" * 5001), (6, "z" * 5000 + " oratiion orationz orations-orations"), (7, "oratoins " * 3)]


def test_texts_with_nulls_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(i, t, "x", "key") for i, t in DOCS], "doc_id long, text string, word string, key string")
    assert as_set(spelling.spelling_groups(df)) == plain_variants(plain_words(DOCS))


def test_every_deletion_place(spark):
    docs = [(i, " ".join(["abcdefgh", "àéöüabcde"] * 2)) for i in range(400)]
    words = spelling.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"), 7, 2, 31, "doc_id", "text")
    assert {r["word"]: r["n"] for r in words.collect()} == plain_words(docs)


def test_no_words_and_no_rows(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_groups(spark.createDataFrame([(1, "all short words")], "doc_id long, text string")).collect() == []


def test_ratio_must_lead_upwards(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_neighbourhood_keys_are_those_of_the_edited_words():
    words, some = pa.array(["abca", "zz", "a"]), ["abca", "bca", "aca", "aba", "abc", "zz", "z", "a", ""]
    keys = dict(zip(some, spelling.word_keys(pa.array(some), 50)))
    got = defaultdict(set)
    for at, found, own in spelling.neighbours(words, 50):
        for i, k in zip(at, found):
            got[words[int(i)].as_py()].add(k)
    for w in words.to_pylist():
        assert {keys[w], *[keys[w[:i] + w[i + 1:]] for i in range(len(w))]} <= got[w]


def test_query_equals_plain_version(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = as_set(QUERIES["op11_spelling_variants"](spark, SF))
    assert got == plain_variants(plain_words(docs))
