"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes around it also starts in a document with a smaller doc_id. Equal strings have
their minimiser (a gram of ``GRAM`` bytes, see ``minimisers``) at the same offset, so it is enough to sort the suffixes that
start at minimisers, one for about fifteen bytes of text, each as far as the last string over its minimiser reaches,
and to carry along the bytes before it.

*Map.* A task sorts its suffixes, drops equal ones, and sends each bucket a run of them, front-coded: of each suffix the
length of the prefix it shares with the one before, and the rest. Buckets are dealt by a hash of the minimiser, the first
bytes of the suffix, so a bucket has all suffixes that start alike.

*Reduce.* A loser tree merges the runs of a bucket. Each contender carries the length of the prefix it shares with
the suffix given out last. The one that shares more comes first without a look at its bytes; only at equal lengths bytes are
compared, from that length on. The tree gives out the order and the shared prefix lengths of neighbours, which
split the order into groups of equal prefixes: for each offset of the minimiser in the string, the strings of a group whose
bytes before the minimiser are the same too are equal, and those of a larger doc_id than the group's least are repeats.

What keeps this small and even: a census of minimisers first, as only those with two places or more can lie in
repeated strings; equal suffixes with equal bytes before them (copies of a passage) are one entry for each task, under
the smallest doc_id that the task has for it, and the other documents' spans are known without asking. A minimiser that has
more than ``HOT`` different entries (a phrase in many contexts) would fill a bucket by itself, more the larger the corpus: each
string of ``LENGTH`` bytes over it is an entry of its own, dealt by a hash of the whole string, so they are spread over all
buckets; equal strings still meet, and their bytes are compared in the merge as the others' are.

Defined cases: a null text is empty; a null doc_id comes after all others; rows of one doc_id don't count as each
other's repeats, though they lose what smaller ones have; an empty table gives no rows. A text longer than a batch is a
batch by itself; one of 2^30 bytes or more stops the job with an error, none is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import GOLDEN, mix64, pieces, texts
from lendlens.llm.minimisers import Runs, census, gram_hashes, travelling
from lendlens.llm.sorted_files import SortedFiles
from lendlens.llm.spans import SPANS, covered, joined, keyed, pack_parts, span_table, unpack_parts, with_spans

LENGTH = 50
GRAM = 20
BATCH_BYTES = 2 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 2 << 20
#: Bytes of suffixes that a task keeps before it sends them.
HELD_BYTES = 16 << 20
#: Different entries of one minimiser that may meet in a bucket; about as many as a bucket has bytes for.
HOT = 1 << 15
SENT = "bucket int, kind int, data binary"
_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def byte_runs(batch: list[bytes], gram: int, length: int) -> tuple[bytes, np.ndarray, Runs]:
    """The texts end to end, where each ends, and the runs of strings that share a minimiser."""
    data = b"".join(batch)
    ends = np.cumsum([len(x) for x in batch], dtype=np.int64)
    symbols = _SYMBOLS[np.frombuffer(data + bytes(gram - 1), np.uint8)]
    return data, ends, Runs(gram_hashes(symbols, gram), ends, gram, length)


def _minimisers(gram: int, length: int):
    def runs(batch: pa.RecordBatch) -> Iterator[Runs]:
        for piece in pieces(iter([batch]), "text", BATCH_BYTES):
            yield byte_runs(texts(piece.column("text")), gram, length)[2]

    return runs


def _numbers(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def shared_prefixes(suffixes: list[bytes]) -> np.ndarray:
    """Of sorted byte strings, how many bytes each shares with the one before."""
    lengths = np.fromiter(map(len, suffixes), np.int64, len(suffixes))
    if not len(lengths):
        return lengths
    width = int(lengths.max()) + 1
    rows = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in suffixes]), np.uint8).reshape(-1, width)
    differ = rows[1:] != rows[:-1]
    differ[:, -1] = True
    shared = np.minimum(differ.argmax(axis=1), np.minimum(lengths[1:], lengths[:-1]))
    return np.concatenate([[0], shared])


def front_coded(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared lengths, lengths, and the bytes that are left; of sorted strings of up to 255 bytes."""
    shared = shared_prefixes(suffixes)
    rest = b"".join([x[n:] for x, n in zip(suffixes, shared.tolist(), strict=True)])
    return shared.astype(np.uint8).tobytes(), bytes(map(len, suffixes)), rest


def decoded(shared: bytes, lengths: bytes, rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for same, length in zip(shared, lengths, strict=True):
        stop = at + length - same
        last = last[:same] + rest[at:stop]
        at = stop
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs, each its strings and their shared prefix lengths.

    Returns the run that each place of the merged order comes from, and the length of the prefix that the string
    there shares with the one before it. A contender's length is what it shares with the last string given out.
    """
    size = 1
    while size < len(runs):
        size *= 2
    count = [len(r[0]) for r in runs] + [0] * (size - len(runs))
    strings = [r[0] for r in runs]
    shared = [r[1] for r in runs]
    place = [0] * size
    length = [0 if n else -1 for n in count]  # -1: the run is at its end and loses to all
    now = [r[0] if r else b"" for r in strings] + [b""] * (size - len(runs))

    def first_of(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes what it shares with the winner."""
        x, y = length[a], length[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = now[a], now[b]
        if s == t:
            length[b] = len(s)
            return a, b
        low, high = x, min(len(s), len(t))
        while low < high:  # the first place past the known prefix where they differ
            middle = (low + high + 1) // 2
            if s[x:middle] == t[x:middle]:
                low = middle
            else:
                high = middle - 1
        if s < t:
            length[b] = low
            return a, b
        length[a] = low
        return b, a

    loser = [0] * size
    winner = list(range(size))
    level = size
    while level > 1:
        level //= 2
        pairs = [first_of(winner[2 * i], winner[2 * i + 1]) for i in range(level)]
        for i, (_, lost) in enumerate(pairs):
            loser[level + i] = lost
        winner = [won for won, _ in pairs]
    top = winner[0]
    order: list[int] = []
    lengths: list[int] = []
    while length[top] >= 0:
        order.append(top)
        lengths.append(length[top])
        at = place[top] = place[top] + 1
        if at < count[top]:
            now[top] = strings[top][at]
            length[top] = shared[top][at]
        else:
            length[top] = -1
        node = (size + top) // 2
        while node:
            other = loser[node]
            x, y = length[top], length[other]
            if y > x:
                loser[node], top = top, other
            elif x == y and x >= 0:
                top, loser[node] = first_of(top, other)
            node //= 2
    return order, lengths


class _Held:
    """What a task has found since it last sent: for each distinct suffix with the bytes before it, who has it."""

    def __init__(self):
        self.entries: dict[tuple[bytes, bytes], int] = {}
        self.values: list[int] = []
        self.size = 0
        self.batches: list[tuple] = []

    def add(self, data: bytes, ends: np.ndarray, runs: Runs, key: np.ndarray, id: np.ndarray, length: int) -> None:
        number = np.empty(len(runs), np.int64)
        entries, values = self.entries, self.values
        stop = runs.last + length
        rows = zip(runs.first.tolist(), runs.anchor.tolist(), stop.tolist(), runs.value.tolist(), strict=True)
        for i, (a, p, b, value) in enumerate(rows):
            at = entries.setdefault((data[p:b], data[a:p]), len(values))
            if at == len(values):
                values.append(value)
                self.size += b - a
            number[i] = at
        document = np.searchsorted(ends, runs.first, "right")
        begin = np.concatenate([[0], ends])[document]
        self.batches.append((number, runs.first, runs.anchor, stop, document, begin, ends, key, id))

    def send(self, buckets: int) -> Iterator[pa.RecordBatch]:
        least = np.full(len(self.values), np.iinfo(np.int64).max)
        for number, _, _, _, document, _, _, _, id in self.batches:
            np.minimum.at(least, number, id[document])
        known, holders = [], []
        for number, first, anchor, stop, document, begin, ends, key, id in self.batches:
            later = id[document] > least[number]
            of, start, end = joined(first[later], stop[later], ends)
            known.append((key[of], id[of], start, end))
            own = ~later
            holders.append((number[own], key[document[own]], (anchor - begin)[own]))
        entries = list(self.entries)
        bucket = (mix64(np.array(self.values, np.uint64) ^ GOLDEN) % np.uint64(buckets)).astype(np.int64)
        pack = zstandard.ZstdCompressor(level=3).compress
        order = np.array(sorted(range(len(entries)), key=entries.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        held = [np.concatenate(x) for x in zip(*holders, strict=True)] if holders else [np.zeros(0, np.int64)] * 3
        by_rank = np.argsort(rank[held[0]], kind="stable")
        number, key, place = (x[by_rank] for x in held)
        ranks = rank[number]
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() if len(order) else []
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
            part = order[a:b].tolist()
            suffixes = [entries[i][0] for i in part]
            before = [entries[i][1] for i in part]
            low, high = np.searchsorted(ranks, [a, b])
            data = pack_parts(
                *front_coded(suffixes), bytes(map(len, before)), b"".join(before), _numbers(least[order[a:b]]),
                _numbers(np.bincount(ranks[low:high] - a, minlength=b - a)), _numbers(key[low:high]), _numbers(place[low:high]),
            )
            rows.append((int(bucket[part[0]]), 0, pack(data)))
        spans = [np.concatenate(x) for x in zip(*known, strict=True)] if known else [np.zeros(0, np.int64)] * 4
        if len(spans[0]):
            rows.append((int(spans[0][0] ^ spans[1][0]) % buckets, 1, pack(pack_parts(*map(_numbers, spans)))))  # any bucket will do
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["bucket", "kind", "data"]
        )


def _send(files: SortedFiles, buckets: int, gram: int, length: int, hot: int):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in pieces(batches, "text", BATCH_BYTES):
            data, ends, found = byte_runs(texts(batch.column("text")), gram, length)
            key, id = (batch.column(c).to_numpy() for c in ("key", "id"))
            for runs in travelling(files, found, hot):
                held.add(data, ends, runs, key, id, length)
                if held.size > HELD_BYTES:
                    yield from held.send(buckets)
                    held = _Held()
        yield from held.send(buckets)

    return sent


def repeated_offsets(
    suffixes: list[bytes], before: list[bytes], ids: np.ndarray, shared: np.ndarray, length: int, gram: int
) -> np.ndarray:
    """For each entry of the merged order and each offset of the minimiser, whether a smaller doc_id has that string.

    An entry's strings have the offsets from ``length`` less its suffix's length up to the number of bytes before it.
    """
    n, most = len(suffixes), length - gram
    found = np.zeros((n, most + 1), bool)
    low = length - np.fromiter(map(len, suffixes), np.int64, n)
    high = np.fromiter(map(len, before), np.int64, n)
    next_shared = np.concatenate([shared[1:], [0]]) if n else shared
    # An entry that shares too little with both neighbours has no equal.
    open_ = np.flatnonzero(length - high <= np.maximum(shared, next_shared))
    group_of = np.zeros(n, np.int64)
    left = np.zeros(n, np.int64)  # a number for the bytes before the minimiser, as far as the offset goes
    rows = np.frombuffer(b"".join([before[i][::-1].ljust(most, b"\0") for i in open_.tolist()]), np.uint8).reshape(-1, most)
    index = np.full(n, -1, np.int64)
    index[open_] = np.arange(len(open_))
    for offset in range(most + 1):
        live = open_[high[open_] >= offset]
        if not len(live):
            break
        if offset:
            byte = rows[index[live], offset - 1]
            left[live] = np.unique(left[live] * 256 + byte, return_inverse=True)[1]
        live = live[low[live] <= offset]
        if not len(live):
            continue
        np.cumsum(shared < length - offset, out=group_of)
        key = group_of[live] * (n + 1) + left[live]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.minimum.reduceat(ids[live[order]], first)
        sizes = np.diff(np.concatenate([first, [len(key)]]))
        found[live[order], offset] = ids[live[order]] > np.repeat(least, sizes)
    return found


def _merge(length: int, gram: int):
    def merged(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        spans, runs, others = [], [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
            parts = unpack_parts(unpack(data.as_py()))
            if kind:
                spans.append([np.frombuffer(x, np.int64) for x in parts])
                continue
            runs.append((decoded(*parts[:3]), list(parts[0])))
            cuts = np.concatenate([[0], np.cumsum(np.frombuffer(parts[3], np.uint8), dtype=np.int64)]).tolist()
            before = [parts[4][a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            others.append((before, *(np.frombuffer(x, np.int64) for x in parts[5:])))
        if runs:
            order, shared = merge_runs(runs)
            source = np.array(order, np.int64)
            # The k-th entry of a run in the merged order is its k-th.
            by_run = np.argsort(source, kind="stable")
            at = np.empty(len(order), np.int64)
            at[by_run] = np.arange(len(order))
            flat_before = [x for o in others for x in o[0]]
            flat_suffixes = [x for r in runs for x in r[0]]
            ids = np.concatenate([o[1] for o in others])
            holders = np.concatenate([o[2] for o in others])
            keys, places = (np.concatenate([o[i] for o in others]) for i in (3, 4))
            numbers = at.tolist()
            found = repeated_offsets(
                [flat_suffixes[i] for i in numbers], [flat_before[i] for i in numbers], ids[at], np.array(shared, np.int64), length, gram
            )
            # Neighbouring offsets are strings that start at neighbouring places.
            edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            entry, start = np.nonzero(edges == 1)
            _, stop = np.nonzero(edges == -1)
            number = at[entry]
            begin = np.cumsum(holders) - holders
            copies = holders[number]
            holder = np.repeat(begin[number], copies) + np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
            place = places[holder]
            first, last = place - np.repeat(stop - 1, copies), place - np.repeat(start, copies) + length
            spans.append([keys[holder], np.repeat(ids[number], copies), first, last])
        return span_table(*(np.concatenate(x) for x in zip(*spans, strict=True))) if spans else span_table(*[np.zeros(0)] * 4)

    return merged


def sent_entries(rows: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """What the tasks send to the buckets."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, total // BUCKET_BYTES + 1)
    files = census(rows.select("text"), _minimisers(gram, length), "byte-minimisers")
    return rows.select("text", "key", "id").mapInArrow(_send(files, buckets, gram, length, hot), SENT)


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key, id, start, stop (in bytes) of what strings that a smaller doc_id has cover; ``rows`` are keyed."""
    return sent_entries(rows, length, gram, hot).groupBy("bucket").applyInArrow(_merge(length, gram), SPANS)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 4 * BATCH_BYTES):
        out = []
        for text, spans in zip(texts(batch.column("text")), batch.column("spans"), strict=True):
            kept, count = text, 0
            if spans.is_valid:
                gone = covered(spans.values.to_numpy(), len(text))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                count = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            out.append((len(text), len(text) - len(kept), count, kept))
        n, removed, count, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left) of each document."""
    rows = keyed(docs)
    found = with_spans(rows, repeated_spans(rows, length, gram, hot))
    return found.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    kept = remove_repeated(docs)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS i, h FROM t WHERE length(h) >= 100
), w AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS string FROM s
), again AS (
  SELECT doc_id, i FROM w JOIN (SELECT string, min(doc_id) AS first_id FROM w GROUP BY string) USING (string)
  WHERE doc_id > first_id
), marked AS (
  SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS new FROM again
), numbered AS (
  SELECT doc_id, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM spans
), kept AS (
  SELECT t.doc_id, any_value(h) AS h, coalesce(sum(b - a), 0) AS n_removed, count(a) AS n_spans,
    coalesce(string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a), '') AS head, coalesce(max(b), 0) AS last
  FROM t LEFT JOIN gaps ON gaps.doc_id = t.doc_id GROUP BY t.doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
  sha256(unhex(head || substr(h, 2 * last + 1))) AS kept_sha256
FROM kept
"""
