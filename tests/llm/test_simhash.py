import random
import re

import pytest
import xxhash

from tersus.llm import simhash
from tersus.llm.suite import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, bits=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(fps))]


TEXTS = ["", None, " \t\n", "one", "one two", "One Two", "a b c", "a b c a b c a b c", "É é x", "a b c d", "x y z w " * 5000,
         "long " * 3 + "tail"]


def test_fingerprints_equal_plain_version(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def test_long_text_is_counted_in_pieces(monkeypatch):
    text = " ".join(str(random.Random(1).random()) for _ in range(500))
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("pairs_up_to, blocks", [(1, 5), (32, 5), (2, 3), (32, 4)])
def test_links_join_exactly_what_all_pairs_join(spark, pairs_up_to, blocks):
    r = random.Random(5)
    fps = set()
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            fps.add(x)
            for _ in range(r.choice([0, 1, 2, 3])):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [(simhash._signed(f),) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), 2, blocks, pairs_up_to).collect()
    assert all(bin((x["a"] ^ x["b"]) % (1 << 64)).count("1") <= 2 for x in links)
    roots = {x["node"]: x["root"] for x in simhash.connected_components(
        simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), 2, blocks, pairs_up_to)).collect()}
    ids = [s for s, in signed]
    expected = plain_components(ids, fps)
    assert [roots.get(s, s) for s in ids] == expected


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (200, 202)]
    got = {r["node"]: r["root"] for r in simhash.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert simhash.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    expected = {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash_near_dedup"](spark, SF).collect()}
    assert got == expected


def test_nulls_ties_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(3, None, 1), (2, "", 2), (None, " ", 3), (None, "a b c d", 4), (5, "x y z", 5), (5, "x y z", 6)],
                               "doc_id long, text string, fp int")
    got = sorted(map(str, [(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()]))
    assert got == sorted(map(str, [(3, 2), (2, 2), (None, 2), (None, None), (5, 5), (5, 5)]))
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in kept.collect()])) == sorted(
        map(str, [(2, ""), (None, "a b c d"), (5, "x y z"), (5, "x y z")]))
    assert simhash.simhash_components(df.limit(0)).count() == 0
