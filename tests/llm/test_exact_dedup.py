import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import BLANK, corpus, table

from lendlens.llm import exact_dedup


def wanted(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[hashlib.sha256(BLANK.sub(" ", text or "").encode()).hexdigest()].append(doc_id)
    out = []
    for digest, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return out


@pytest.mark.parametrize("history", [None, "true", "false", "doc_id > 50"])
def test_report(spark, history):
    found = exact_dedup.report(table(spark, extra=True), history and F.expr(history)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted(corpus())))


def test_empty(spark):
    assert exact_dedup.report(table(spark, [])).count() == 0
    assert exact_dedup.distinct_documents(table(spark, [])).count() == 0


def test_documents_that_stay(spark):
    docs = table(spark, extra=True)
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(i) for i, k, *_ in wanted(corpus()) if i == k})


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_hash_is_minimal_and_perfect(n):
    digests = np.frombuffer(np.random.default_rng(n).bytes(32 * (n + 200)), np.uint64).reshape(-1, 4)
    sizes, bits = exact_dedup.build_hash(digests[:n])
    assert sorted(exact_dedup.slots(digests[:n], sizes, bits).tolist()) == list(range(n))
    others = exact_dedup.slots(digests[n:], sizes, bits)
    assert others.max(initial=-1) < n


def test_nonmembers_that_land_on_a_slot_are_told_apart(spark):
    docs = table(spark, [(i, f"text {i}", "en", "a") for i in range(400)])
    found = exact_dedup.report(docs, F.col("doc_id") < 200).collect()
    assert all(r.kept and r.group_size == 1 and r.keep_id == r.doc_id for r in found) and len(found) == 400


@pytest.mark.parametrize("history", ["doc_id < 10", "false"])
def test_a_small_history_does_not_gather_the_new_digests(spark, monkeypatch, history):
    dealt = []
    look_up = exact_dedup.look_up
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 50)
    monkeypatch.setattr(exact_dedup, "look_up", lambda new, index, shards: dealt.append((new.count(), shards)) or look_up(new, index, shards))
    docs = table(spark, [(i, f"text {i % 390}", "en", "a") for i in range(400)])
    found = exact_dedup.report(docs, F.expr(history)).collect()
    assert all(shards * 50 >= new for new, shards in dealt) and dealt
    assert sorted(r.doc_id for r in found if not r.kept) == list(range(390, 400))
