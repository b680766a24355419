"""A minimiser that many contexts share: its strings are spread over the buckets, and the result stays that of brute force."""

import hashlib
import random

import pytest
import zstandard
from rows import table
from test_removal import same, strings_gone, windows_gone

from lendlens.llm import suffix_merge, superkmers
from lendlens.llm.common import GOLDEN, mix64
from lendlens.llm.spans import keyed, unpack_parts


def busiest(sent, part, width):
    """Strings of the fullest bucket, and of all buckets."""
    counts = {}
    for row in sent.where("kind = 0").collect():
        parts = unpack_parts(zstandard.ZstdDecompressor().decompress(bytes(row.data)))
        counts[row.bucket] = counts.get(row.bucket, 0) + len(parts[part]) // width
    return max(counts.values()), sum(counts.values())


def in_contexts(phrase, other, n):
    """The phrase in documents that share nothing else, but for each fifth, which repeats the one before."""
    rows = []
    for i in range(n):
        text = rows[-1][1] if i % 5 == 4 else other() + phrase + other()
        rows.append((i, text, "en", "a"))
    return rows


def word_rows(n):
    rng = random.Random(1)
    words = lambda k: " ".join(f"w{rng.randrange(10**9)}" for _ in range(k))
    first = lambda p: mix64(superkmers.Words([p.encode()], 4, 4).runs.value ^ GOLDEN)[0]
    phrase = min((words(4) for _ in range(300)), key=first)
    return in_contexts(f" {phrase} ", lambda: words(8), n)


def byte_rows(n):
    rng = random.Random(2)
    text = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    first = lambda p: mix64(suffix_merge.byte_runs([p.encode()], 8, 8)[2].value ^ GOLDEN)[0]
    phrase = min((text(8) for _ in range(300)), key=first)
    return in_contexts(phrase, lambda: text(12), n)


def test_windows_of_a_frequent_phrase_are_spread(spark):
    rows = keyed(table(spark, word_rows(600)))
    gathered = busiest(superkmers.sent_strings(rows, 12, 4, 10**9), 0, 8)
    most, all_ = busiest(superkmers.sent_strings(rows, 12, 4, 50), 0, 8)
    assert gathered[0] == gathered[1] and most < all_ / 4


def test_strings_of_a_frequent_phrase_are_spread(spark):
    rows = keyed(table(spark, byte_rows(600)))
    gathered = busiest(suffix_merge.sent_entries(rows, 20, 8, 10**9), 1, 1)
    most, all_ = busiest(suffix_merge.sent_entries(rows, 20, 8, 50), 1, 1)
    assert gathered[0] > 0.9 * gathered[1] and most < all_ / 4


@pytest.mark.parametrize("hot", [1, 3, 50])
def test_words_with_frequent_phrases(spark, hot):
    rng = random.Random(hot)
    parts = [" ".join(rng.choices("abc", k=rng.randint(1, 40))) + " " for _ in range(12)]
    rows = word_rows(200) + [(1000 + i, "".join(rng.choices(parts, k=rng.randint(0, 6))), "en", "a") for i in range(60)]
    found = superkmers.remove_repeated(table(spark, rows), 12, 4, hot).collect()
    same([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found], windows_gone(rows, 12))


@pytest.mark.parametrize("hot", [1, 3, 50])
def test_bytes_with_frequent_phrases(spark, hot):
    rng = random.Random(hot)
    parts = ["".join(rng.choices(["a", "b", "é", "\x00"], k=rng.randint(1, 60))) for _ in range(12)]
    rows = byte_rows(200) + [(1000 + i, "".join(rng.choices(parts, k=rng.randint(0, 6))), "en", "a") for i in range(60)]
    found = suffix_merge.remove_repeated(table(spark, rows), 20, 8, hot).collect()
    wanted = strings_gone(rows, 20)
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found], wanted)
