import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import corpus, labels, prose, table, words

from lendlens.llm import llr_rules, quality_qda

SF_DIR = "/root/testdata/sf0.01"


def shouted(seed, n):
    return " ".join(f"{w.upper()}!!" for w in prose(seed, n).split())


def training():
    rows = [(i, shouted(i, 60 + i % 50) if i % 5 == 0 else prose(i, 60 + i % 50) + ".", "en", "a") for i in range(300)]
    return rows, [(i, int(i % 5 != 0), 0) for i in range(300)]


def test_score_is_that_of_two_normal_densities():
    rng = np.random.default_rng(0)
    n = len(quality_qda.NAMES)
    parts = {c: rng.normal(c, 1 + c, (200, n)) for c in (0, 1)}
    sums = {c: (float(len(x)), x.sum(axis=0), x.T @ x) for c, x in parts.items()}
    model = quality_qda._from_sums(sums, 0.1, 0.01)
    x = rng.normal(0.5, 1, (5, n))
    both = sum((v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in parts.values()) / 400
    logs = []
    for c in (0, 1):
        own = 0.9 * np.cov(parts[c].T, bias=True) + 0.1 * both
        own = 0.99 * own + 0.01 * np.trace(own) / n * np.eye(n)
        away = x - parts[c].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(own), away) - 0.5 * np.linalg.slogdet(own)[1])
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_held_out_documents(spark):
    docs, marks = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_qda.report(docs, marks).join(marks, "doc_id").where("held_out and quality is not null")
    right, n = rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 80 and right > 0.97


def test_scores_of_odd_documents(spark):
    docs = table(spark, extra=True)
    found = quality_qda.report(docs, labels(spark)).collect()
    assert len(found) == len(corpus())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    none = quality_qda.report(docs, labels(spark, [])).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_qda.report(table(spark, []), labels(spark)).count() == 0


def test_accepted_documents(spark):
    rows, marks = training()
    kept = quality_qda.accepted_documents(table(spark, rows, extra=True), labels(spark, marks))
    assert kept.columns == table(spark, extra=True).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, quality, _ in marks if quality}


def base_numbers(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def base_failed(text):
    w = words(text)
    counts = {}
    for i in range(len(w) - 2):
        counts[tuple(w[i : i + 3])] = counts.get(tuple(w[i : i + 3]), 0) + 1
    again = {i + j for i in range(len(w) - 2) if counts[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_base_numbers(spark):
    found = llr_rules.report(table(spark, extra=True), labels(spark)).collect()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = [r for r in corpus() if len(r[1] or "") < 20_000]
    wanted = sorted(repr((r[0], *base_numbers(r[1]))) for r in rows)
    ids = {r[0] for r in rows}
    assert sorted(repr(tuple(r[n] for n in names)) for r in found if r.doc_id in ids) == wanted
    assert not any(r.kept for r in found if r.base_failed)


def test_verdicts(spark):
    rows, marks = training()
    found = llr_rules.report(table(spark, rows), labels(spark, marks[:200])).collect()
    assert {r.doc_id for r in found if r.kept} == {i for i, quality, _ in marks if quality}


def test_log_ratios(spark):
    rows, marks = training()
    docs = llr_rules.with_trusted(table(spark, rows), labels(spark, marks))
    found = llr_rules.log_ratios(docs, 64, 1.0).first()
    counted = docs.select("trusted", llr_rules._hashes(llr_rules._words()).alias("h"))
    counted = counted.select("trusted", "h", llr_rules._pairs("h", 64).alias("p")).collect()
    assert sum(r.trusted for r in counted) == sum(quality for _, quality, _ in marks)
    raw, good = np.zeros(64), np.zeros(64)
    for r in counted:
        buckets = [x % 64 for x in r.h] + r.p
        np.add.at(raw, buckets, 1)
        np.add.at(good, buckets, r.trusted)
    for name, own in (("other", 0), ("trusted", 1)):
        wanted = np.log((good - own + 1) / (good.sum() + 64)) - np.log(raw / (raw.sum() + 64))
        assert found[name] == pytest.approx(wanted.tolist())


def test_ratio_and_verdict_of_each_document(spark):
    """``llr`` and ``kept`` of whole rows from the hashes of whole words, in numpy."""
    rows = corpus() + [(1000 + i, shouted(i, 80), "en", "a") for i in range(10)]
    marks = labels(spark)
    n = 512
    df = table(spark, rows, extra=True)
    found = llr_rules.report(df, marks, buckets=n, threshold=-0.05).collect()
    hashed = llr_rules.with_trusted(df, marks).select("doc_id", "text", "trusted", llr_rules._hashes(llr_rules._words()).alias("h"))
    hashed = hashed.select("doc_id", "text", "trusted", "h", llr_rules._pairs("h", n).alias("p")).collect()
    grams = [np.array([x % n for x in r.h] + r.p, np.int64) for r in hashed]
    raw, good = np.zeros(n), np.zeros(n)
    for r, g in zip(hashed, grams):
        np.add.at(raw, g, 1)
        np.add.at(good, g, r.trusted)
    wanted = []
    for r, g in zip(hashed, grams):
        assert len(g) == 2 * len(words(r.text))
        up = np.log((good[g] - r.trusted + 1) / (good.sum() + n)) - np.log(raw[g] / (raw.sum() + n))
        llr = up.mean() if len(g) else 0.0
        wanted.append((repr(r.doc_id), round(llr, 9), not base_failed(r.text) and llr >= -0.05))
    assert sorted((repr(r.doc_id), round(r.llr, 9), r.kept) for r in found) == sorted(wanted)
    assert {k for *_, k in wanted} == {True, False} and any(not k and not base_failed(r.text) for r, (*_, k) in zip(hashed, wanted))


def test_held_out_rates(spark):
    """With two thirds of the labels trusted, good texts of the other third stay, but for a stray one of so small a corpus,
    and most bad ones go."""
    docs, marks = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    good: dict = {}
    for r in marks.where("doc_id % 3 = 1 and quality is not null").collect():
        good[r.doc_id] = max(r.quality, good.get(r.doc_id, 0))
    found = llr_rules.report(docs, marks.where("doc_id % 3 <> 1")).collect()
    kept = {q: [r.kept for r in found if not r.base_failed and good.get(r.doc_id) == q] for q in (0, 1)}
    assert len(kept[1]) > 50 and sum(kept[1]) >= 0.98 * len(kept[1])
    assert kept[0] and sum(kept[0]) < 0.5 * len(kept[0])


def test_without_trusted_texts(spark):
    found = llr_rules.report(table(spark), labels(spark, [])).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in found)
    assert llr_rules.report(table(spark, []), labels(spark)).count() == 0
