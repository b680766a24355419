import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import corpus, prose, table, words

from lendlens.llm import kneser_ney


def tokens(text):
    return [w.encode().lower() for w in words(text)] + [b" "]


class Brute:
    """The textbook's rules on dictionaries of n-grams."""

    def __init__(self, texts, order=2):
        self.order, self.count, longest = order, Counter(), Counter()
        for t in map(tokens, texts):
            self.count.update(t)
            longest.update(self.grams(t))
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.counts = {order: longest}
        for k in range(order, 1, -1):
            self.counts[k - 1] = Counter(g[1:] for g in self.counts[k])
        self.d = {k: self.discounts(c) for k, c in self.counts.items()}
        self.total, self.kinds = Counter(), {}
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                self.total[g[:-1]] += c
                self.kinds.setdefault(g[:-1], [0, 0, 0])[min(c, 3) - 1] += 1
        self.words = max(sum(self.counts[1].values()), 1)
        self.left = sum(self.d[1][min(k, 3)] for k in self.counts[1].values()) if self.counts[1] else 1.0

    def grams(self, t):
        padded = [None] * (self.order - 1) + t
        return [tuple(padded[i : i + self.order]) for i in range(len(t))]

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        if not all(n[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        textbook = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        return [0] + [min(d, k) if d > 0 else 0.5 for k, d in enumerate(textbook, 1)]

    def p(self, gram):
        context, k = gram[:-1], len(gram)
        c = self.counts[k][gram]
        gain = c - self.d[k][min(c, 3)] if c else 0
        if k == 1:
            return gain / self.words + self.left / self.words / (self.v + 1)
        if not self.total[context]:
            return self.p(gram[1:])
        back = sum(d * n for d, n in zip(self.d[k][1:], self.kinds[context], strict=True)) / self.total[context]
        return gain / self.total[context] + back * self.p(gram[1:])

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.count[w] + 1) / (self.n + self.v + 1)) for w in t)
        return len(t), sum(w in self.count for w in t), base, sum(math.log10(self.p(g)) for g in self.grams(t))


def check(found, rows, model):
    wanted = sorted(((r[0], *model.row(r[1])) for r in rows), key=repr)
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in found), key=repr)
    for a, b in zip(found, wanted, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


def held_out_rows(rows):
    return [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_report(spark, order):
    rows = corpus()
    out = held_out_rows(rows)
    assert out
    model = Brute([r[1] for r in rows if r not in out], order)
    found = kneser_ney.report(table(spark, extra=True), order=order).collect()
    check(found, rows, model)
    assert {r.doc_id for r in found if r.held_out} == {r[0] for r in out}
    assert {r.train_tokens for r in found} == {model.n}


@pytest.mark.parametrize("order", [2, 3])
def test_ids_that_take_more_bits_than_a_key(spark, order):
    rows = corpus()
    model = kneser_ney.train(table(spark, rows), order, width=10)
    assert all(g.keys.high and len(g.sizes) == 1 << g.keys.high for g in model.grams)
    check(kneser_ney.score(table(spark, rows), model).collect(), rows, Brute([r[1] for r in rows], order))


def test_many_ranges_of_ids(spark, monkeypatch):
    model = kneser_ney.train(table(spark), 3)
    assert all(g.size < kneser_ney.ID_RANGE for g in model.grams)
    monkeypatch.setattr(kneser_ney, "ID_RANGE", 16)
    rows = np.arange(5 * 16).reshape(5, 16) * 17
    target = kneser_ney.Rows(model.grams[0].folder + "/more")
    for number in (0, 3):
        target.write(number, rows + number)
    found = target.of(np.array([50, -1, 0, 15, 63]))
    assert found.T.tolist() == [(rows[:, 2] + 3).tolist(), [0] * 5, rows[:, 0].tolist(), rows[:, 15].tolist(), (rows[:, 15] + 3).tolist()]


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_of_a_context_add_up(order):
    model = Brute([r[1] for r in corpus()], order)
    seen = [g[:-1] for g in model.counts[order]][:20]
    for context in [(None,) * (order - 1), (b"w1",) * (order - 1), (b"never",) * (order - 1), *seen]:
        assert sum(model.p((*context, w)) for w in [*model.count, b"never"]) == pytest.approx(1)


def test_order_below_two(spark):
    with pytest.raises(ValueError):
        kneser_ney.train(table(spark), 1)


def triplicates():
    """Pages that come three times, one that comes twice, some four times or once."""
    pages = [f"page{i} " + " ".join(f"p{i}w{j}" for j in range(12)) for i in range(40)]
    rows = [p for p in pages[:30] for _ in range(3)] + [pages[30]] * 2 + [p for p in pages[31:33] for _ in range(4)] + pages[33:]
    return [(i, t, "en", "a") for i, t in enumerate([*rows, *(p + " never seen" for p in pages)])]


@pytest.mark.parametrize("order", [2, 3])
def test_no_probability_is_zero_where_pages_repeat(spark, order):
    rows = triplicates()
    out = [r for r in rows if "never" in r[1]]
    model = Brute([r[1] for r in rows if "never" not in r[1]], order)
    n = Counter(model.counts[order].values())
    y = n[1] / (n[1] + 2 * n[2])
    assert 2 - 3 * y * n[3] / n[2] < 0  # what the formula says of counts of two
    assert all(0 < d <= k for less in model.d.values() for k, d in enumerate(less[1:], 1))
    assert all(model.p(g) > 0 for _, t, *_ in out for g in model.grams(tokens(t)))
    found = kneser_ney.report(table(spark, rows), F.col("doc_id") >= rows.index(out[0]), order).collect()
    check(found, rows, model)
    assert all(math.isfinite(r.score) and math.isfinite(r.perplexity) for r in found)


@pytest.mark.parametrize("n", [[100, 10, 50, 5, 0], [1, 1, 1000, 1, 0], [5, 4, 3, 1000, 0], [1000, 1, 1, 1, 1], [0, 0, 0, 0, 9], [3, 0, 1, 1, 0]])
def test_discounts_are_above_zero(n):
    found = kneser_ney.discounts(n).tolist()
    assert found[0] == 0 and all(0 < d <= k for k, d in enumerate(found[1:], 1))


def test_a_text_longer_than_a_batch(spark):
    long = "ab cd " * (kneser_ney.BATCH_BYTES // 5)
    rows = [(1, long, "en", "a"), (3, "ab cd", "en", "a"), (4, "cd ab ef", "en", "a")]
    check(kneser_ney.report(table(spark, rows), F.lit(False)).collect(), rows, Brute([r[1] for r in rows], kneser_ney.ORDER))


def test_without_training_texts(spark):
    docs = table(spark, [(1, "a b", "en", "a"), (2, None, "en", "a")])
    found = kneser_ney.report(docs, F.lit(True)).collect()
    assert all(r.score == r.base_score == 0 and r.n_known == 0 for r in found) and len(found) == 2
    assert kneser_ney.report(table(spark, [])).count() == 0


def test_held_out_texts_score_better_than_by_words_alone(spark):
    rows = [(i, " ".join(f"{a} {a}x" for a in prose(i, 60, 40).split()), "en", "a") for i in range(120)]
    found = [r for r in kneser_ney.report(table(spark, rows)).collect() if r.held_out]
    assert found and sum(r.score for r in found) > sum(r.base_score for r in found) * 0.75


@pytest.mark.parametrize(("most", "width"), [(1, 64), (1000, 64), (2**31, 64), (2**33, 64), (2**40, 64), (1000, 12), (1000, 4)])
def test_keys_are_one_to_one(most, width):
    before, after = np.random.default_rng(0).integers(0, most + 1, (2, 3000))
    keys = kneser_ney.Keys(most, width)
    part, key = keys.of(before, after)
    assert (keys.high > 0) == (2 * most.bit_length() > width) and part.max() < keys.parts
    for number in np.unique(part):
        at = part == number
        x, y = keys.ids(int(number), key[at])
        assert (x == before[at]).all() and (y == after[at]).all()
