from collections import Counter

import corpus_pipeline
from rows import corpus, labels, prose, table


def rows():
    extra = [(1000 + i, prose(500 + i, 80 + i) + ".", "en", "abc"[i % 3]) for i in range(40)]
    junk = [(2000 + i, " ".join(f"{w.upper()}!!" for w in prose(700 + i, 70).split()), "en", "a") for i in range(12)]
    return corpus() + extra + junk


def sf_dir(spark, tmp_path, documents):
    table(spark, documents, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(1000 + i, 1, 0) for i in range(30)] + [(2000 + i, 0, 0) for i in range(9)]
    labels(spark, marks).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    folder = sf_dir(spark, tmp_path, rows())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    good, exact, near, mixed, encoded = counts
    assert not any(i and i >= 2000 for i in good) and all(1000 + i in good for i in range(40))
    assert set(exact) <= set(good) and set(near) <= set(exact) and set(mixed) <= set(near) and encoded == mixed
    assert max(near.values()) == 1 and max(mixed.values()) <= 2
    assert 100 in exact and 101 not in exact and 200 in near and 201 in exact and 201 not in near
    run = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in run) == encoded and all(r.round_trip for r in run)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir(spark, tmp_path, [])).count() == 0
