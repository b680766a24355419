"""Removal of repeated windows of words and of repeated byte strings, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from rows import corpus, table, words

from lendlens.llm import minimisers, suffix_merge, superkmers


def windows_gone(rows, window):
    texts = [words(text) for _, text, *_ in rows]
    counts = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc_id, *_), t in zip(rows, texts, strict=True):
        gone = {i + j for i in range(len(t) - window + 1) if counts[tuple(t[i : i + window])] > 1 for j in range(window)}
        kept = " ".join(w for i, w in enumerate(t) if i not in gone)
        out.append((doc_id, len(t), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def strings_gone(rows, length):
    first = {}
    order = lambda i: float("inf") if i is None else i
    texts = [(text or "").encode() for _, text, *_ in rows]
    for (doc_id, *_), t in zip(rows, texts, strict=True):
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            first[s] = min(first.get(s, float("inf")), order(doc_id))
    out = []
    for (doc_id, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < order(doc_id):
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def random_rows(seed, alphabet, most):
    rng = random.Random(seed)
    parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, most))) for _ in range(12)]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))), "en", "a") for i in range(60)]


def same(found, wanted):
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_words(spark):
    same(superkmers.report(table(spark, extra=True)).collect(), windows_gone(corpus(), 35))


def test_bytes(spark):
    same(suffix_merge.report(table(spark, extra=True)).collect(), strings_gone(corpus(), 50))


@pytest.mark.parametrize("seed", range(3))
def test_words_of_a_small_alphabet(spark, seed):
    rows = random_rows(seed, ["a ", "b ", "c\n", "  "], 60)
    found = superkmers.remove_repeated(table(spark, rows), 12, 4).collect()
    wanted = windows_gone(rows, 12)
    same([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found], wanted)


@pytest.mark.parametrize("seed", range(3))
def test_bytes_of_a_small_alphabet(spark, seed):
    rows = random_rows(seed, ["a", "b", "é", "\x00"], 60)
    found = suffix_merge.remove_repeated(table(spark, rows), 15, 4).collect()
    wanted = strings_gone(rows, 15)
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found], wanted)


def test_empty(spark):
    assert superkmers.report(table(spark, [])).count() == 0
    assert suffix_merge.report(table(spark, [])).count() == 0


def test_rows_of_one_doc_id_with_other_texts(spark):
    rows = [(1, "x" * 80, "en", "a"), (1, "y" * 30 + "x" * 80, "en", "a"), (0, "z" + "x" * 55, "en", "a")]
    same(suffix_merge.report(table(spark, rows)).collect(), strings_gone(rows, 50))


def test_front_coding():
    rng = random.Random(3)
    strings = sorted(bytes(rng.choices(b"ab\x00", k=rng.randint(0, 9))) for _ in range(500))
    assert suffix_merge.decoded(*suffix_merge.front_coded(strings)) == strings


@pytest.mark.parametrize("runs", [1, 2, 3, 7, 16])
def test_merge_knows_the_shared_prefixes(runs):
    rng = random.Random(runs)
    parts = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 8))) for _ in range(rng.randint(0, 60))) for _ in range(runs)]
    order, shared = suffix_merge.merge_runs([(p, suffix_merge.shared_prefixes(p).tolist()) for p in parts])
    at = [iter(p) for p in parts]
    merged = [next(at[run]) for run in order]
    assert merged == sorted(x for p in parts for x in p)
    assert shared == suffix_merge.shared_prefixes(merged).tolist()


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(superkmers, "gram_hashes", lambda symbols, n: np.zeros(len(symbols) - n + 1, np.uint64))
    found = superkmers.repeated_windows([b"a b c d", b"x a b c", b"q q q"], np.array([False, False, True]), 3)
    assert [x.tolist() for x in found] == [[True, False], [False, True], [True]]


def test_runs_have_the_leftmost_minimiser_of_each_window():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 4, 400).astype(np.uint64)
    ends = np.array([100, 100, 103, 250, 400])
    runs = minimisers.Runs(minimisers.gram_hashes(np.concatenate([symbols, np.zeros(2, np.uint64)]), 3), ends, 3, 10)
    starts = np.concatenate([[0], ends[:-1]])
    windows = [i for a, b in zip(starts, ends, strict=True) for i in range(a, b - 9)]
    assert [i for a, b in zip(runs.first, runs.last, strict=True) for i in range(a, b + 1)] == windows
    offsets = {}
    for a, b, p in zip(runs.first, runs.last, runs.anchor, strict=True):
        for i in range(a, b + 1):
            assert i <= p <= i + 7
            assert offsets.setdefault(tuple(symbols[i : i + 10]), p - i) == p - i
