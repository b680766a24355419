import random
from collections import defaultdict

import numpy as np
import pytest
from rows import corpus, prose, table, words

from lendlens.llm import partenum
from lendlens.operators.components import components


def shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def wanted(rows):
    sets = [shingles(text) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for group in groups.values():
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), rows[i][0] if len(group) == 1 else least) for i in group]
    return sorted(map(repr, out))


def crowd(seed):
    """Chains of near copies with very common passages, some of them just under the limit."""
    rng = random.Random(seed)
    common = prose(seed, 40).split()
    rows = []
    for k in range(6):
        text = prose(100 + 10 * seed + k, 120, 1000).split()
        for _ in range(25):
            text = list(text)
            text[rng.randrange(len(text))] = f"n{rng.random()}"
            rows.append(" ".join(common + text if k % 2 else text + common))
    rows += [" ".join(common + prose(i, 12, 5000).split()) for i in range(60)]
    rng.shuffle(rows)
    return [(i, x, "en", "a") for i, x in enumerate(rows)]


def test_report(spark):
    found = partenum.report(table(spark, extra=True)).collect()
    assert sorted(repr(tuple(r)) for r in found) == wanted(corpus())


@pytest.mark.parametrize("group", [2, 5, 1024])
def test_frequent_signatures_dealt_out_in_groups(spark, group):
    rows = crowd(group)
    found = partenum.report(table(spark, rows), group).collect()
    assert sorted(repr(tuple(r)) for r in found) == wanted(rows)


def test_representatives(spark):
    docs = table(spark, extra=True)
    kept = partenum.representatives(docs)
    assert kept.columns == docs.columns
    found = sorted(str(r.doc_id) for r in kept.collect())
    assert found == sorted({x.split(",")[0][1:] for x in wanted(corpus()) if x.split(", ")[0][1:] == x.split(", ")[2][:-1]})


def test_empty(spark):
    assert partenum.report(table(spark, [])).count() == 0
    assert partenum.representatives(table(spark, [(1, None, None, None), (2, "", None, None)])).count() == 2


def test_similar_sets_share_a_signature():
    rng, pick = np.random.default_rng(0), random.Random(0)
    pairs = 0
    for _ in range(120):
        n = pick.choice([1, 2, 3, 4, 5, 6, 8, 10, 15, 25, 40, 80, 200, 600])
        base = rng.integers(0, 2**63, n, dtype=np.uint64).tolist()
        sets = []
        for _ in range(10):
            one = set(base)
            for _ in range(pick.randint(0, max(1, n // 6))):
                if pick.random() < 0.5 and len(one) > 1:
                    one.remove(pick.choice(sorted(one)))
                else:
                    one.add(int(rng.integers(0, 2**63)))
            sets.append(np.array(sorted(one), np.uint64))
        number, signature = partenum.signatures(sets)
        own = [set(signature[number == i].tolist()) for i in range(10)]
        for i in range(10):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    pairs += 1
                    assert own[i] & own[j]
    assert pairs > 1000


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 3, 7, 15, 17, 60, 300, 1100):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for cut in range(0, n, max(1, n // 12)):
            sets.append(np.unique(np.concatenate([base[cut // 2 :], rng.integers(0, 2**63, cut // 3, dtype=np.uint64)])))

    class Held:
        def many(self, ids):
            return [partenum.sketch(sets[i]) for i in ids]

    a, b = np.triu_indices(len(sets), 1)
    may = partenum.Sketches(Held(), np.arange(len(sets))).may_be_similar(a, b)
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    sizes = np.array([len(x) for x in sets])
    similar = 100 * both >= 75 * (sizes[a] + sizes[b] - both)
    assert similar.sum() > 50 and not (similar & ~may).any()
    assert may.sum() < 3 * similar.sum()


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40 + i, 40) for i in range(9)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert dict(map(tuple, found)) == {i: 0 for i in range(21)} | {40 + i: 40 for i in range(9)}
