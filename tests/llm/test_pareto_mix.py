from collections import Counter, defaultdict

import pytest
from rows import corpus, prose, table, words

from lendlens.llm import pareto_mix


def reshared(sizes, weights, share, cap):
    """Targets by sharing the excess again and again."""
    left, targets = set(sizes), dict.fromkeys(sizes, 0.0)
    rest = share * sum(sizes.values())
    while left and rest > 1e-9:
        whole = sum(weights[s] for s in left)
        parts = {s: targets[s] + rest * weights[s] / whole for s in left}
        rest = sum(max(0.0, p - cap * sizes[s]) for s, p in parts.items())
        for s, p in parts.items():
            targets[s] = min(p, cap * sizes[s])
        left = {s for s in left if targets[s] < cap * sizes[s] - 1e-9}
    return targets


def sources():
    sizes = Counter({"a": 0, "b": 0, "c": 0, "d": 0, None: 0})
    for _, text, _, source in corpus():
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    return sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}


def test_targets(spark):
    sizes, weights = sources()
    wanted = reshared(sizes, weights, 1.5, 2)
    docs = table(spark, extra=True)
    by_source = {}
    for doc_id, size, source_size, target, taken, copies in pareto_mix.mix(docs).collect():
        assert 0 <= taken <= 2 * size and taken == size * copies
        by_source[source_size] = target
    assert by_source == pytest.approx({sizes[s]: wanted[s] for s in sizes}, rel=1e-9)


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, prose(i, 5 + i * 7 % 400), "en", f"s{i % 4}") for i in range(800)]
    taken, targets = Counter(), {}
    for r in pareto_mix.mix(table(spark, rows)).collect():
        taken[r.doc_id % 4] += r.taken
        targets[r.doc_id % 4] = r.target
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 10


def test_reruns_agree(spark):
    docs = table(spark)
    once = sorted(pareto_mix.mix(docs).collect(), key=repr)
    assert once == sorted(pareto_mix.mix(docs.repartition(7, "text")).collect(), key=repr)
    assert once != sorted(pareto_mix.mix(docs, seed=1).collect(), key=repr)


def test_longer_documents_are_likelier(spark):
    rows = [(i, prose(i, 8 if i % 2 else 200), "en", "ab"[i // 1500]) for i in range(3000)]
    copies = defaultdict(int)
    for r in pareto_mix.mix(table(spark, rows), share=0.3, exponent=0.5).collect():
        copies[r.size] += r.copies
    assert copies[200] > 1.5 * copies[8] > 0


def test_documents(spark):
    docs = table(spark, extra=True)
    mixed = pareto_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    wanted = Counter()
    for r in pareto_mix.mix(docs).collect():
        wanted[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +wanted


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "a b", None, "x")]])
def test_small_tables(spark, rows):
    found = pareto_mix.mix(table(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in found)
