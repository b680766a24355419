"""The audit of sources against a plain count, and the packing of terms against sorted bytes."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from rows import CLASHING

from lendlens.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, least=10, top=10):
    docs = [(t, lang or "", source or "") for t, lang, source in docs]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in docs:
        counts[lang, source].update(terms(t))
        seen[lang].update(set(terms(t)))
    rows = []
    for lang, source in counts:
        kept = sorted(w for w, n in seen[lang].items() if n >= least)
        sources = sorted(s for g, s in counts if g == lang)

        def shares(count):
            whole = sum(count[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (count[w] + 2) // whole for w in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = shares(counts[lang, source])
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        pairs = []
        for other in sources:
            if other != source:
                theirs = shares(counts[lang, other])
                pairs.append((sum(f(p[w], theirs[w]) for w in kept), other))
        found = [(f(p[w], q[w]), w) for w in kept if counts[lang, source][w] and p[w] > q[w]]
        for part, values in (("pair", pairs), ("term", found)):
            values.sort(key=lambda x: (-x[0], x[1].encode()))
            rows += [(lang, source, part, w, v, i) for i, (v, w) in enumerate(values, 1) if part == "pair" or i <= top]
    return sorted(rows)


def documents(spark, rows, extra=False):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    if extra:
        df = df.selectExpr("*", *[f"cast(1 AS {t}) AS `{c}`" for c, t in (x.split() for x in CLASHING.split(", "))])
        df = df.selectExpr("*", "1 AS term", "2 AS count", "'x' AS bucket", "0 AS place", "1 AS p", "1 AS at", "1 AS data")
    return df.repartition(4)


def audited(df, **options):
    found = divergence.audit(df, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "ÉTÉ", "été", "a" * 8, "A" * 9, "b" * 16, "b" * 17, "日本語", "日本語日本語", "x", "é", "c" * 70, "ﬀ", "ſ"]
    vocabulary += ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 22))) for _ in range(60)]
    marks = [" ", "\n", "-", "1", "\x00", "@", "[", "`", "{", "\x7f", " ", ", "]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", "", None, "e\tn", "e\nn", "e\\n"])
        source = rng.choice(["s1", "s1", "s1", "s2", "s10", "é", None, "", "a\tb", "\\"])
        text = "".join(rng.choice(vocabulary[: rng.randrange(5, 75)]) + rng.choice(marks) for _ in range(rng.randrange(0, 60)))
        rows.append((text, lang, source))
    return rows + [(None, "en", "s1"), ("", "fr", "only"), (None, None, None), ("1 2 3", "fr", "other"), *[("same words here", "en", "s2")] * 12]


def test_against_a_plain_count(spark):
    rows = corpus()
    assert audited(documents(spark, rows)) == by_hand(rows)


def test_other_numbers(spark):
    rows = corpus(2, 120)
    assert audited(documents(spark, rows, extra=True), least=3, top=4) == by_hand(rows, 3, 4)


def test_many_sources_in_blocks(spark):
    rows = [(" ".join(random.Random(i).choices(["a", "b", "c", "d", "e"], k=9)), "en", f"s{i % 23}") for i in range(200)]
    df = documents(spark, rows)
    kept = divergence.kept_terms(df)
    totals = divergence.group_totals(df, kept)
    whole = sorted(map(tuple, divergence.pair_values(kept, totals).collect()))
    assert len(whole) == 23 * 22 // 2
    assert sorted(map(tuple, divergence.pair_values(kept, totals, sources=4).collect())) == whole
    assert audited(df) == by_hand(rows)


def test_terms_that_two_blocks_lack(spark):
    """Each source has terms of its own: what no source of a pair has still counts for it, by the sources' sizes."""
    rows = [(f"all own{i % 6} " + f"further{i % 6} " * (i % 6), "en", f"s{i % 6}") for i in range(90)]
    df = documents(spark, rows)
    kept = divergence.kept_terms(df)
    totals = divergence.group_totals(df, kept)
    whole = sorted(map(tuple, divergence.pair_values(kept, totals).collect()))
    assert sorted(map(tuple, divergence.pair_values(kept, totals, sources=2).collect())) == whole
    assert audited(df) == by_hand(rows)


def test_an_empty_table(spark):
    assert audited(documents(spark, []).where("false")) == []


def test_a_text_longer_than_a_batch(spark):
    rows = [("word Other " * (divergence.BATCH_BYTES // 10), "en", "a"), *[("word other", "en", "b")] * 10]
    assert audited(documents(spark, rows)) == by_hand(rows)


@pytest.mark.parametrize("size", [0, 1, 2, 1000])
def test_radix_order(size):
    rng = np.random.default_rng(size)
    low, high = rng.integers(0, 5, size).astype(np.uint32), rng.integers(0, 2**63, size).astype(np.uint64) % np.uint64(7**20)
    assert (divergence.radix_order(low, high) == np.lexsort((low, high))).all()


def test_terms_of_texts_end_to_end():
    texts = ["abc", "", "def", "É", "1x", "y", "", " a b", "Zz-"]
    found = divergence.Found(pa.array(["??", *texts]).slice(1))
    got = [(int(r), found.bytes[a : a + n].tobytes().decode()) for r, a, n in zip(found.row, found.start, found.length)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in terms(t)]


def test_packed_terms_sort_like_their_bytes():
    words = sorted({w for t, *_ in corpus(5) for w in terms(t) if len(w.encode()) <= 16}, key=str.encode)
    found = divergence.Found(pa.array([" ".join(words)]))
    everything = np.arange(len(words))
    keys = [found.words(everything, 0), found.words(everything, 8)]
    assert (np.lexsort((keys[1], keys[0])) == everything).all()
    assert divergence._texts_of(keys) == words


def test_the_sql_agrees_with_the_plain_count(spark):
    rows = corpus(3, 150)
    con = duckdb.connect()
    con.register("documents", pa.table({k: [*v] for k, v in zip(("text", "lang", "source"), zip(*rows))}))
    assert sorted(con.execute(divergence.ORACLE).fetchall()) == by_hand(rows)
