"""An interpolated modified Kneser-Ney model of n-grams of any order, counted in Spark and scored from memory-mapped arrays.

*Counting.* Each task counts its words by a 64-bit hash and sends the sorted distinct hashes with their counts, cut by
ranges of the hash, to the tasks that add them up. These write a file for each range: the hashes in order, then the
counts. A word's ID is its rank in all files. An n-gram of k words is known by two IDs, that of its first k - 1 words and
that of its last k - 1, and is counted by a one-to-one scramble of the two (``Keys``), so that frequent words are spread
over all ranges; its own ID is again its rank. So the lengths are counted one after the other, up to the order.

A second, smaller round for each length, from the longest down, adds up by ID what the model needs of the n-grams one
word shorter: as a context the sum of the counts over its successors, and the numbers of successors of counts 1, 2 and
more; as an ending the number of words before it. The latter is the count that the shorter n-grams go by.

*Scoring.* Workers memory-map these files. They look up the sorted distinct n-grams of a batch of texts by binary search,
range by range, so a file is passed once per batch. Nothing of the model passes through the driver but the number of
n-grams in each range and the counts of counts (a dozen numbers for each length) that give the discounts.

With c the count of an n-gram, of h and then w (of the longest: how often it occurs, else how many words come before it),
D1, D2, D3 the discounts of its length for counts 1, 2 and more, and h' the context without its first word:

    p(w | h) = (c - D(c)) / total(h) + (D1 n1(h) + D2 n2(h) + D3 n3(h)) / total(h) * p(w | h')
    p(w) = (k - E(k)) / pairs + (E1 m1 + E2 m2 + E3 m3) / pairs / (V + 1)

where k is the number of words before w, m1, m2, m3 the numbers of words with one, two and more before them, and the unknown
word is the one more than V. A context that did not occur leaves p(w | h'). Before a text stand order - 1 marks for its
start, which are contexts only; the mark for its end is a token.

Defined cases: a null text is empty and has the end as its one token; without training texts each token has probability 1
by both models; every probability is above zero, on any corpus; rows that repeat count as often as they stand, also with
one doc_id or none, a null doc_id being the empty text for the choice of training texts; a text longer than a batch is a batch
by itself; an empty table gives no rows. IDs are 64 bits wide: where two of them take more than 64 bits, the rest of the
bits names a folder of files. An order below two raises an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import held_out, mix64, pieces, staged, texts
from lendlens.llm.files import mapped, new_folder, pack_numbers, unpack_numbers, write_whole
from lendlens.llm.sorted_files import BLOBS, SortedFiles, added, blob_batch, blobs, sizes_of, unpacked

BATCH_BYTES = 8 << 20
#: Words before a token that the query's model looks at, and the token itself.
ORDER = 2
#: Tokens that a range of n-grams holds on average, before equal ones are added up.
RANGE_TOKENS = 2_000_000
#: IDs in a range of the second round.
ID_RANGE = 1 << 18
USUAL = 0.5
#: No word has a blank in it.
END = b" "
_FACTORS = (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)


class Keys:
    """One-to-one keys for two IDs of up to ``most``: a part and 64 sortable bits, both spread evenly.

    The key has as many bits as the two IDs need, at the top of the 64; beyond 64 (``width``) the rest make the part.
    """

    def __init__(self, most: int, width: int = 64):
        self.bits = max(1, int(most).bit_length())
        self.low = max(min(2 * self.bits, width), self.bits)
        self.high = 2 * self.bits - self.low
        self.parts = 1 << self.high
        self.mask = np.uint64((1 << self.low) - 1)
        self.half, self.up = np.uint64((self.low + 1) // 2), np.uint64(64 - self.low)

    def _scrambled(self, x: np.ndarray, factors) -> np.ndarray:
        # A shift by half of the bits or more undoes itself.
        with np.errstate(over="ignore"):
            for f in factors:
                x = x ^ (x >> self.half)
                x = (x * np.uint64(f & int(self.mask))) & self.mask
            return x ^ (x >> self.half)

    def _part_mask(self, key: np.ndarray) -> np.ndarray:
        return mix64(key) >> np.uint64(64 - self.high)

    def of(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, after = before.astype(np.uint64), after.astype(np.uint64)
        x = ((before << np.uint64(self.bits)) | after) & self.mask
        key = self._scrambled(x, _FACTORS) << self.up
        if not self.high:
            return np.zeros(len(key), np.int64), key
        part = (before >> np.uint64(self.low - self.bits)) ^ self._part_mask(key)
        return part.astype(np.int64), key

    def ids(self, part: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two IDs of each key of a part."""
        x = self._scrambled(key >> self.up, [pow(f, -1, 1 << self.low) for f in reversed(_FACTORS)])
        before = x >> np.uint64(self.bits)
        if self.high:
            before = before | ((np.uint64(part) ^ self._part_mask(key)) << np.uint64(self.low - self.bits))
        return before.astype(np.int64), (x & np.uint64((1 << self.bits) - 1)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places of its keys."""
    if parts == 1:
        yield 0, np.arange(len(part))
        return
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    if len(found):
        yield from zip(found.tolist(), np.split(order, first[1:]), strict=True)


class _Codes(dict):
    """Numbers the words of a batch by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class Tokens:
    """The tokens of a batch of texts: codes into its distinct words, and where each text ends."""

    def __init__(self, batch: list[bytes]):
        words: list[bytes] = []
        ends = []
        for text in batch:
            words += text.lower().split()
            words.append(END)
            ends.append(len(words))
        numbers = _Codes()
        self.codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:].tolist()


def discounts(n: list[int]) -> np.ndarray:
    """Of counts 0 (none), 1, 2, 3 and more, from the numbers of counts 1 to 4.

    A discount is above zero and at most its count: where the formula gives none, or one of zero or below, as it does
    where a corpus repeats whole texts, the discount of that count is ``USUAL``. So a context always has some probability
    left for what does not follow it in training.
    """
    if min(n[:4], default=0) <= 0:
        return np.array([0.0, USUAL, USUAL, USUAL])
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return np.array([0.0, *(min(d, k + 1.0) if d > 0 else USUAL for k, d in enumerate(found))])


class Grams:
    """The distinct n-grams of one length with their counts, in sorted files for each part of their keys."""

    def __init__(self, keys: Keys, folder: str, sizes: np.ndarray):
        self.keys, self.folder, self.sizes = keys, folder, sizes.reshape(keys.parts, -1)
        self.size = int(sizes.sum())
        self.first = np.concatenate([[0], np.cumsum(self.sizes.sum(axis=1))]).astype(np.int64)

    def files(self, part: int) -> SortedFiles:
        return SortedFiles(f"{self.folder}/{part}", self.sizes[part])

    def find(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each two IDs a place in the ID and count of the distinct n-grams; the last place is for unknown ones (-1)."""
        both = np.flatnonzero((before >= 0) & (after >= 0))
        part, key = self.keys.of(before[both], after[both])
        codes = np.full(len(before), -1, np.int64)
        ids, counts, size = [], [], 0
        for number, at in _by_part(part, self.keys.parts):
            distinct, inverse = np.unique(key[at], return_inverse=True)
            rank, count = self.files(number).look_up(distinct)
            codes[both[at]] = inverse + size
            size += len(distinct)
            ids.append(np.where(rank >= 0, rank + self.first[number], -1))
            counts.append(count)
        codes[codes < 0] = size
        return codes, np.concatenate([*ids, [-1]]), np.concatenate([*counts, [0]])


class Rows:
    """Five numbers for each ID: total, n1, n2, n3 of it as a context, and the number of words before it.

    A file for each range of IDs has them as one byte each, and the larger ones apart.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, number: int, rows: np.ndarray) -> None:
        flat = rows.ravel()
        large = np.flatnonzero(flat >= 255)
        write_whole(
            f"{self.folder}/{number:08d}", np.array([len(large)], np.int64).tobytes(), large.astype(np.int64).tobytes(),
            flat[large].astype(np.int64).tobytes(), np.minimum(flat, 255).astype(np.uint8).tobytes(),
        )

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The five rows, of zeros for an ID of -1."""
        found = np.zeros((5, len(ids)), np.int64)
        known = np.flatnonzero(ids >= 0)
        known = known[np.argsort(ids[known], kind="stable")]
        of = ids[known] // ID_RANGE
        numbers, first = np.unique(of, return_index=True)
        for number, at in zip(numbers.tolist(), np.split(known, first[1:]), strict=False):
            large, more, small = _open_rows(f"{self.folder}/{number:08d}")
            places = (ids[at] - number * ID_RANGE) + np.arange(5)[:, None] * ID_RANGE
            values = small[places].astype(np.int64)
            big = values == 255
            values[big] = more[np.searchsorted(large, places[big])]
            found[:, at] = values
        return found


@lru_cache(maxsize=4096)
def _open_rows(uri: str) -> tuple[np.ndarray, ...]:
    raw = mapped(uri)
    n = int(raw[:8].view(np.int64)[0])
    a, b = 8 + 8 * n, 8 + 16 * n
    return raw[8:a].view(np.int64), raw[a:b].view(np.int64), raw[b:]


def _before(codes: np.ndarray, starts: np.ndarray, mark: int) -> np.ndarray:
    """The code one place earlier, at the start of a text the mark's."""
    before = np.concatenate([[mark], codes[:-1]])
    before[starts] = mark
    return before


def _word_ids(tokens: Tokens, words: SortedFiles) -> tuple[np.ndarray, np.ndarray]:
    """ID (-1: none) and count of each distinct word."""
    order = np.argsort(tokens.hashes)
    rank, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order], count[order] = words.look_up(tokens.hashes[order])
    return rank, count


class Model:
    """What a worker needs to score: where the files are, and the numbers that hold for all.

    ``grams`` and ``rows`` begin with the pairs, ``gram_discounts`` with the words; ``kinds`` are m1, m2, m3 of the words.
    """

    def __init__(self, words: SortedFiles, grams: list[Grams], rows: list[Rows], tokens: int, gram_discounts: list[np.ndarray], kinds: list[int]):
        self.words, self.grams, self.rows, self.tokens = words, grams, rows, tokens
        self.gram_discounts = gram_discounts
        self.vocabulary = int(words.sizes.sum())
        left = float(np.dot(gram_discounts[0][1:], kinds)) if grams[0].size else 1.0
        self.pair_total = max(grams[0].size, 1)
        self.unknown = left / self.pair_total / (self.vocabulary + 1)

    def _rows(self, level: int, ids: np.ndarray) -> np.ndarray:
        return self.rows[level].of(ids) if self.tokens else np.zeros((5, len(ids)), np.int64)

    def score(self, tokens: Tokens) -> dict[str, np.ndarray]:
        rank, count = _word_ids(tokens, self.words)
        # The mark for the start is a context; its ID comes after all words', as that of only marks after all n-grams'.
        ids, codes = np.concatenate([rank, [self.vocabulary]]), tokens.codes
        rows = self._rows(0, ids)
        single = np.full(len(ids), self.unknown)
        seen = np.flatnonzero(rows[4])
        single[seen] += (rows[4, seen] - self.gram_discounts[0][np.minimum(rows[4, seen], 3)]) / self.pair_total
        p = single[codes]
        for level, grams in enumerate(self.grams):
            less = self.gram_discounts[level + 1]
            before = _before(codes, tokens.starts, len(ids) - 1)
            scale = 1 / np.maximum(rows[0], 1)
            back = np.where(rows[0] > 0, (less[1:] @ rows[1:4]) * scale, 1.0)
            p *= back[before]
            codes, found, times = grams.find(ids[before], ids[codes])
            ids = np.concatenate([found, [grams.size]])
            if level + 1 < len(self.grams):
                rows, scales = self._rows(level + 1, ids), scale[before]
                times = rows[4, :-1]
            else:
                scales = scale[before]
            p += np.where(times > 0, times - less[np.minimum(times, 3)], 0.0)[codes] * scales

        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))
        add = lambda x: np.add.reduceat(x, tokens.starts) if len(tokens.starts) else x
        return {
            "n_tokens": tokens.ends - tokens.starts,
            "n_known": add((count > 0)[tokens.codes].astype(np.int64)),
            "base_score": add(base[tokens.codes]),
            "score": add(np.log10(p)),
        }


def _count_words(ranges: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in pieces(batches, "text", BATCH_BYTES):
            tokens = Tokens(texts(batch.column("text")))
            keys.append(tokens.hashes)
            counts.append(np.bincount(tokens.codes, minlength=len(tokens.hashes)))
            if sum(map(len, keys)) > RANGE_TOKENS:
                k, c = added(keys, counts)
                keys, counts = [k], [c]
                if len(k) > RANGE_TOKENS:
                    yield blobs(k, c, ranges)
                    keys, counts = [], []
        yield blobs(*added(keys, counts), ranges)

    return counted


def _write_words(folder: str):
    def written(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        keys, counts = unpacked(table)
        SortedFiles.write(folder, number, keys, counts)
        return pa.table({"range": pa.array([number], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())]})

    return written


def _count_grams(words: SortedFiles, shorter: list[Grams], keys: Keys, ranges: int):
    """Count the n-grams one word longer than the longest of ``shorter`` (else pairs), by parts and ranges of their keys."""
    start = int(words.sizes.sum())

    def sent(sums: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for part, held in sums.items():
            batch = blobs(*added(*map(list, zip(*held, strict=True))), ranges)
            yield batch.set_column(0, "range", pc.add(batch.column(0), pa.scalar(part * ranges, pa.int32())))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, size = defaultdict(list), 0
        for batch in pieces(batches, "text", BATCH_BYTES):
            tokens = Tokens(texts(batch.column("text")))
            ids, codes = np.concatenate([_word_ids(tokens, words)[0], [start]]), tokens.codes
            for grams in shorter:
                codes, found, _ = grams.find(ids[_before(codes, tokens.starts, len(ids) - 1)], ids[codes])
                ids = np.concatenate([found, [grams.size]])
            part, key = keys.of(ids[_before(codes, tokens.starts, len(ids) - 1)], ids[codes])
            for number, at in _by_part(part, keys.parts):
                sums[number].append(np.unique(key[at], return_counts=True))
                size += len(sums[number][-1][0])
            if size > 2 * RANGE_TOKENS:
                yield from sent(sums)
                sums, size = defaultdict(list), 0
        yield from sent(sums)

    return counted


def _row_blobs(before: np.ndarray, after: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """What distinct n-grams add to the rows of their contexts and endings, by range of IDs."""
    order = np.argsort(before, kind="stable")
    ids, first = np.unique(before[order], return_index=True)
    later, contexts = np.unique(after, return_counts=True)
    every, inverse = np.unique(np.concatenate([ids, later]), return_inverse=True)
    rows = np.zeros((5, len(every)), np.int64)
    if len(ids):
        for i, x in enumerate((counts, counts == 1, counts == 2, counts >= 3)):
            rows[i, inverse[: len(ids)]] = np.add.reduceat(x[order].astype(np.int64), first)
    rows[4, inverse[len(ids) :]] = contexts
    cuts = np.flatnonzero(np.diff(every // ID_RANGE, prepend=-1)).tolist()
    return [
        (int(every[a] // ID_RANGE), b - a, pack_numbers(every[a:b], *rows[:, a:b])) for a, b in zip(cuts, [*cuts[1:], len(every)], strict=True)
    ]


def _write_grams(folder: str, ranges: int):
    def written(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        key, counts = unpacked(table)
        SortedFiles.write(f"{folder}/{number // ranges}", number % ranges, key, counts)
        kinds = pa.array([_counts_of_counts(counts)], pa.list_(pa.int64()))
        return pa.table({"range": pa.array([number], pa.int32()), "n": [len(key)], "kinds": kinds})

    return written


def _add_rows(grams: Grams, rows: Rows | None):
    """What each range of n-grams adds to the rows one word shorter; the counts are the files', or those in ``rows``."""
    ranges = grams.sizes.shape[1]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (x for batch in batches for x in batch.column(0).to_pylist()):
            part, place = divmod(number, ranges)
            if grams.sizes[part, place]:
                files = grams.files(part)
                key, counts = files.held(place)
                if rows:
                    first = int(grams.first[part] + files.offsets[place])
                    counts = rows.of(np.arange(first, first + len(key)))[4]
                yield blob_batch(_row_blobs(*grams.keys.ids(part, key), counts))

    return made


def _write_rows(target: Rows):
    def written(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        rows = np.zeros((5, ID_RANGE), np.int64)
        for data in table.column("data"):
            ids, *parts = unpack_numbers(data.as_py(), 6)
            at = (ids - np.uint64(number * ID_RANGE)).astype(np.int64)
            for i, x in enumerate(parts):
                rows[i, at] += x.astype(np.int64)
        target.write(number, rows)
        return pa.table({"range": pa.array([number], pa.int32()), "kinds": pa.array([_counts_of_counts(rows[4])], pa.list_(pa.int64()))})

    return written


def train(docs: DataFrame, order: int = ORDER, width: int = 64) -> Model:
    """Count the texts of ``docs`` (all of them) into a model in the shared folder."""
    if order < 2:
        raise ValueError("the order is two or more")
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"))
    folder = new_folder(spark, "grams-model")
    ranges = max(8, docs.rdd.getNumPartitions())
    sent = docs.mapInArrow(_count_words(ranges), BLOBS)
    written = staged(sent.groupBy("range").applyInArrow(_write_words(f"{folder}/words"), "range int, n long, tokens long"))
    made = written.collect()  # a row for each range
    words = SortedFiles(f"{folder}/words", sizes_of([(r["range"], r["n"]) for r in made], ranges))
    tokens = sum(r["tokens"] for r in made)
    size, levels = int(words.sizes.sum()), []
    for length in range(2, order + 1):
        keys = Keys(size, width)
        ranges = max(1, max(8, tokens // RANGE_TOKENS + 1) >> keys.high)
        sent = docs.mapInArrow(_count_grams(words, levels[:], keys, ranges), BLOBS)
        write = _write_grams(f"{folder}/{length}", ranges)
        written = staged(sent.groupBy("range").applyInArrow(write, "range int, n long, kinds array<long>"))
        made = written.collect()  # a row for each range
        levels.append(Grams(keys, f"{folder}/{length}", sizes_of([(r["range"], r["n"]) for r in made], ranges * keys.parts)))
        size = levels[-1].size
    of_counts = [sum(r["kinds"][i] for r in made) for i in range(5)]
    found, rows = [discounts(of_counts)], []
    for grams in reversed(levels):
        numbers = spark.range(0, grams.sizes.size, 1, grams.sizes.size)
        sent = numbers.mapInArrow(_add_rows(grams, rows[0] if rows else None), BLOBS)
        rows.insert(0, Rows(f"{grams.folder}/rows"))
        kinds = staged(sent.groupBy("range").applyInArrow(_write_rows(rows[0]), "range int, kinds array<long>"))
        sums = kinds.agg(*[F.sum(F.col("kinds")[i]).alias(f"k{i}") for i in range(5)]).first()
        of_counts = [int(x or 0) for x in sums]
        found.insert(0, discounts(of_counts))
    return Model(words, levels, rows, tokens, found, [of_counts[0], of_counts[1], sum(of_counts[2:])])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_tokens", "n_known", "base_score", "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            found = shared.value.score(Tokens(texts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[n]) for n in names)], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds the perplexity per token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def report(docs: DataFrame, left_out: Column | None = None, order: int = ORDER) -> DataFrame:
    """Learn from the documents that are not left out, score all."""
    out = held_out(F.col("doc_id"), 7, 2) if left_out is None else left_out
    model = train(docs.where(~out), order)
    rows = perplexity(score(docs, model))
    return rows.withColumn("held_out", out).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
