"""Removal of repeated windows of words by super-k-mer partitioning.

A window is ``WINDOW`` words in a row of one document. Neighbouring windows that share a minimiser (a run of ``GRAM`` words) overlap in
all but a word, and travel together: the words from the first window's start to the last one's end are one packed
string, a super-k-mer, sent to the bucket of its minimiser. All windows with the same words meet in one bucket. There
the windows are sorted, by a hash with the words themselves compared where hashes are equal, and counted.

What keeps this small and even:

- A census of minimisers first counts the strings over each. A window whose minimiser has one place occurs once; it
  stays at home. Nothing that could occur twice is left out.
- A task sends each distinct string once. The windows of a string that a task holds twice are repeated: their spans are
  known without asking, and the string travels only to tell others. So of a passage that a third of all documents share, a
  bucket gets one string from each task.
- A minimiser that has more than ``HOT`` different strings (a phrase in many contexts) would fill a bucket by itself, more the
  larger the corpus. Its windows are sent one by one, as strings of ``WINDOW`` words dealt by a hash of all of them, so they
  are spread over all buckets; equal windows still meet, and their words are compared there as the others' are.
- The strings of a task for a bucket are one compressed row.

Spans of repeated windows go back to their documents by a join on the document, which is even, and the covered words go.

Defined cases: a null text has no words; of rows that repeat doc_id and text each sees the other's windows; texts
with fewer words than a window lose nothing; an empty table gives no rows. A text longer than a batch is a batch by
itself; one of 2^30 words or more stops the job, but takes 2 GB, more than a string of Spark holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import GOLDEN, mix64, pieces, texts
from lendlens.llm.minimisers import Runs, census, gram_hashes, travelling
from lendlens.llm.sorted_files import SortedFiles
from lendlens.llm.spans import SPANS, covered, joined, keyed, pack_parts, span_table, unpack_parts, with_spans

WINDOW = 35
GRAM = 8
BATCH_BYTES = 8 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 2 << 20
#: Bytes of strings that a task keeps before it sends them.
HELD_BYTES = 48 << 20
#: Different strings of one minimiser that may meet in a bucket; about as many as a bucket has bytes for.
HOT = 1 << 13
SENT = "bucket int, kind int, data binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


class Words:
    """The words of a batch of texts, laid end to end, and their runs of windows."""

    def __init__(self, batch: list[bytes], gram: int, window: int):
        self.words: list[bytes] = []
        ends = []
        for text in batch:
            self.words += text.split()
            ends.append(len(self.words))
        self.ends = np.array(ends, np.int64)
        symbols = np.fromiter(map(_Hashes().__getitem__, self.words), np.uint64, len(self.words))
        padded = np.concatenate([symbols, np.zeros(gram - 1, np.uint64)])
        self.runs = Runs(gram_hashes(padded, gram), self.ends, gram, window)


def _minimisers(gram: int, window: int):
    def runs(batch: pa.RecordBatch) -> Iterator[Runs]:
        for piece in pieces(iter([batch]), "text", BATCH_BYTES):
            yield Words(texts(piece.column("text")), gram, window).runs

    return runs


def _numbers(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


class _Held:
    """What a task has found since it last sent: distinct strings, and for each batch its runs."""

    def __init__(self):
        self.strings: dict[bytes, int] = {}
        self.values: list[int] = []
        self.size = 0
        self.batches: list[tuple] = []

    def add(self, words: list[bytes], ends: np.ndarray, runs: Runs, key: np.ndarray, id: np.ndarray, window: int) -> None:
        number = np.empty(len(runs), np.int64)
        strings, values = self.strings, self.values
        rows = zip(runs.first.tolist(), (runs.last + window).tolist(), runs.value.tolist(), strict=True)
        for i, (a, b, value) in enumerate(rows):
            text = b" ".join(words[a:b])
            at = strings.setdefault(text, len(strings))
            if at == len(values):
                values.append(value)
                self.size += len(text)
            number[i] = at
        self.batches.append((number, runs.first, runs.last + window, ends, key, id))

    def send(self, buckets: int) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(self.values), np.int64)
        for number, *_ in self.batches:
            counts += np.bincount(number, minlength=len(counts))
        # Where the strings held once are: place in the document, and the document.
        place = np.zeros((3, len(counts)), np.int64)
        known = []
        for number, first, stop, ends, key, id in self.batches:
            once = counts[number] == 1
            document = np.searchsorted(ends, first[once], "right")
            begin = np.concatenate([[0], ends])[document]
            place[:, number[once]] = key[document], id[document], first[once] - begin
            document, start, end = joined(first[~once], stop[~once], ends)
            known.append((key[document], id[document], start, end))
        bucket = (mix64(np.array(self.values, np.uint64) ^ GOLDEN) % np.uint64(buckets)).astype(np.int64)
        strings = list(self.strings)
        pack = zstandard.ZstdCompressor(level=3).compress
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(order) else order
        rows = []
        for part in np.split(order, cuts[1:]) if len(order) else []:
            part = np.array(sorted(part.tolist(), key=strings.__getitem__))
            text = b"\n".join([strings[i] for i in part.tolist()])
            rows.append((int(bucket[part[0]]), 0, pack(pack_parts(_numbers(counts[part]), _numbers(place[:, part]), text))))
        spans = [np.concatenate(x) for x in zip(*known, strict=True)] if known else [np.zeros(0, np.int64)] * 4
        if len(spans[0]):
            at = int(spans[0][0] ^ spans[1][0]) % buckets  # any bucket will do
            rows.append((at, 1, pack(pack_parts(*map(_numbers, spans)))))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["bucket", "kind", "data"]
        )


def _send(files: SortedFiles, buckets: int, gram: int, window: int, hot: int):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in pieces(batches, "text", BATCH_BYTES):
            found = Words(texts(batch.column("text")), gram, window)
            key, id = (batch.column(c).to_numpy() for c in ("key", "id"))
            for runs in travelling(files, found.runs, hot):
                held.add(found.words, found.ends, runs, key, id, window)
                if held.size > HELD_BYTES:
                    yield from held.send(buckets)
                    held = _Held()
        yield from held.send(buckets)

    return sent


def repeated_windows(strings: list[bytes], many: np.ndarray, window: int) -> list[np.ndarray]:
    """Of each string of words, which of its windows occur twice or more in all; a string in ``many`` counts twice."""
    codes: dict[bytes, int] = {}
    parts = [text.split(b" ") for text in strings]
    lengths = np.array([len(x) for x in parts], np.int64)
    flat = np.fromiter((codes.setdefault(w, len(codes)) for x in parts for w in x), np.int64, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    counts = lengths - window + 1
    of = np.repeat(np.arange(len(strings)), counts)
    at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of]
    hashes = gram_hashes(mix64(flat.astype(np.uint64) + GOLDEN), window)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order[1:]] == hashes[order[:-1]]
    pairs = np.flatnonzero(equal)
    a, b = at[order[pairs]], at[order[pairs + 1]]
    same = np.ones(len(pairs), bool)
    for i in range(window):
        same &= flat[a + i] == flat[b + i]
    again = many[of].copy()
    if same.all():
        again[order[pairs]] = True
        again[order[pairs + 1]] = True
    else:  # different windows of one hash: these are told apart by their words
        by_words: dict[bytes, list[int]] = {}
        for i in np.unique(np.concatenate([order[pairs], order[pairs + 1]])).tolist():
            by_words.setdefault(flat[at[i] : at[i] + window].tobytes(), []).append(i)
        for members in by_words.values():
            if len(members) > 1 or many[of[members[0]]]:
                again[members] = True
    # A window of a string in many marks its equals as well; with them it is a pair, so they are marked above.
    return np.split(again, np.cumsum(counts)[:-1])


def _count(window: int):
    def counted(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        strings: dict[bytes, int] = {}
        numbers, places, spans = [], [], []
        many: list[bool] = []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
            parts = unpack_parts(unpack(data.as_py()))
            if kind:
                spans.append([np.frombuffer(x, np.int64) for x in parts])
                continue
            counts = np.frombuffer(parts[0], np.int64)
            number = []
            for text, count in zip(parts[2].split(b"\n"), counts.tolist(), strict=True):
                at = strings.setdefault(text, len(strings))
                if at == len(many):
                    many.append(count > 1)
                else:
                    many[at] = True
                number.append(at)
            once = counts == 1
            numbers.append(np.array(number, np.int64)[once])
            places.append(np.frombuffer(parts[1], np.int64).reshape(3, -1)[:, once])
        if strings:
            distinct = list(strings)
            again = repeated_windows(distinct, np.array(many), window)
            number, place = np.concatenate(numbers), np.concatenate(places, axis=1)
            for i, (key, id, start) in zip(number.tolist(), place.T.tolist(), strict=True):
                edges = np.flatnonzero(np.diff(again[i].astype(np.int8), prepend=0, append=0))
                if len(edges):
                    a, b = edges[::2] + start, edges[1::2] + start + window - 1
                    spans.append([np.full(len(a), key), np.full(len(a), id), a, b])
        return span_table(*(np.concatenate(x) for x in zip(*spans, strict=True))) if spans else span_table(*[np.zeros(0)] * 4)

    return counted


def sent_strings(rows: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """What the tasks send to the buckets."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, total // BUCKET_BYTES + 1)
    files = census(rows.select("text"), _minimisers(gram, window), "word-minimisers")
    return rows.select("text", "key", "id").mapInArrow(_send(files, buckets, gram, window, hot), SENT)


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key, id, start, stop (in words) of what windows that occur elsewhere cover; ``rows`` are keyed."""
    return sent_strings(rows, window, gram, hot).groupBy("bucket").applyInArrow(_count(window), SPANS)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", BATCH_BYTES):
        out = []
        for text, spans in zip(texts(batch.column("text")), batch.column("spans"), strict=True):
            words = text.split()
            n = len(words)
            if spans.is_valid:
                gone = covered(spans.values.to_numpy(), n)
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            out.append((n, n - len(words), b" ".join(words)))
        n, removed, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) of each document."""
    rows = keyed(docs)
    found = with_spans(rows, repeated_spans(rows, window, gram, hot))
    return found.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept string")


def report(docs: DataFrame) -> DataFrame:
    kept = remove_repeated(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35
), h AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS win FROM s
), again AS (
  SELECT doc_id, i FROM h JOIN (SELECT win FROM h GROUP BY win HAVING count(*) > 1) USING (win)
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM again) GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, words,
    CASE WHEN places IS NULL THEN words
         ELSE list_filter(words, lambda x, k: NOT list_contains(places, k)) END AS left_over
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(left_over))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(left_over, ' '), '')) AS kept_sha256
FROM kept
"""
