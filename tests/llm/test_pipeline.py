"""Each stage of the pipeline against plain decisions on its own input."""
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tersus.llm.common import written
from tersus.llm.suite import QUERIES

from .test_packing import check_table
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), "test-stage"))
    assert all(t.columns == columns for t in tables[:-1])
    raw, good, clean, unique, apart = map(rows, tables[:-1])
    packed = tables[-1].collect()

    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op5_quality_discriminant"](spark, SF).collect()}
    assert sorted(good) == sorted(x for x in raw if scores[x[0]] == 1)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = [i for i, _ in good if labels.get(i) and labels[i]["toxic"] == 0 and i not in dict(clean)]
    left = [i for i, _ in clean if labels.get(i) and labels[i]["toxic"] == 1]
    assert len(lost) <= 2 and len(left) <= 2
    assert len(good) < len(raw) and len(clean) < len(good)

    by_text = defaultdict(list)
    for i, t in clean:
        by_text[t].append(i)
    assert sorted(unique) == sorted((max(ids), t) for t, ids in by_text.items())

    fps = [plain_fingerprint(t) for _, t in unique]
    roots = plain_components([i for i, _ in unique], fps)
    assert sorted(apart) == sorted(x for x, root in zip(unique, roots) if x[0] == root)
    assert len(packed) >= len(apart)

    check_table(packed, apart, 2048)


def test_run_and_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        (table.limit(0) if t == "documents" else table).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_take_nulls_long_texts_repeats_and_clashing_columns(spark, tmp_path):
    """Rows that no stage may lose or crash on, beside the documents that the classifiers learn from."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = next(r for r in docs.join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1 AND toxic = 0"), "doc_id")
                .orderBy("doc_id").collect() if r["n_chars"] > 400)
    long = " ".join([good["text"]] * (1_500_000 // len(good["text"])))
    word = "w" * 1_000_000
    odd = [(10**9, None), (10**9 + 1, ""), (10**9 + 2, long), (10**9 + 3, long), (10**9 + 4, word), (None, good["text"] + " more"),
           (10**9 + 5, long), (10**9 + 5, long)]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    more = spark.createDataFrame(odd, "doc_id long, text string")
    extra = {c: F.lit(None).cast(kinds[c]) for c in docs.columns if c not in ("doc_id", "text")}
    table = docs.unionByName(more.withColumns(extra)).withColumns({c: F.lit(1) for c in ("key", "label", "score", "fp", "digest", "copies")})
    table.write.parquet(str(tmp_path / "documents.parquet"))
    sf, table = "/root/testdata/sf0.001", spark.read.parquet(str(tmp_path / "documents.parquet"))

    def pairs(df):
        assert df.columns == table.columns
        return Counter((r["doc_id"], r["text"]) for r in df.collect())
    raw = pairs(table)
    for _, stage in corpus_pipeline.STAGES[:2]:  # equal texts are kept or dropped alike, null ones as empty ones
        kept = pairs(stage(spark, table, sf))
        by_text = defaultdict(set)
        for x, n in raw.items():
            by_text[x[1] or ""].add(kept[x] == n)
            assert kept[x] in (0, n)
        assert all(len(s) == 1 for s in by_text.values())
    unique = written(corpus_pipeline.exact_dedup(spark, table, sf), "test-stage")
    mine = sorted((i or 0, len(t or "")) for i, t in pairs(unique) if i is None or i >= 10**9)
    assert mine == sorted([(0, len(good["text"]) + 5), (10**9 + 1, 0), (10**9 + 4, len(word)), (10**9 + 5, len(long))])
    assert sum(pairs(unique).values()) == len({t or "" for _, t in raw})
    apart = pairs(corpus_pipeline.near_dedup(spark, unique, sf))
    assert set(apart) <= set(pairs(unique)) and (10**9 + 4, word) in apart
    packed = corpus_pipeline.packing(spark, unique, sf).collect()
    check_table(packed, [(r["doc_id"], r["text"]) for r in unique.collect()], 2048)
