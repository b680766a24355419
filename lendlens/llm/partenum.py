"""Near-duplicate documents by an exact Jaccard join of word shingles with PartEnum signatures.

Sets are compared at a Jaccard similarity of 3/4 or more. Sizes fall into bands, each reaching 4/3 as far as it begins, so
similar sets lie in one band or in neighbours. In band j, with r the largest size, similar sets differ in at most
k = 2 r / 7 shingles. The domain of shingles is dealt by a hash into n partitions and each of these into ``PARTS`` parts. If n
exceeds k / 2, some partition holds at most one of the differences, and of the signatures that leave out one of its
parts, one leaves out that difference: the two sets share it. A set has signatures for its own band and the next one.

A part of the domain where both sets have nothing says little, so signatures of nothing are not used. A set is *safe* if more
than k / 2 of its partitions have shingles in two parts or more: then it shares a signature of something with every
similar set. A set that isn't gets signatures by other hashes as well until it is safe, so of two similar sets, both have
those of the hash at which the first of them is safe. One that is safe with none of ``SEEDS`` hashes has each of its
shingles as a signature as well.

What is exact and what it costs:

- Documents of equal sets are one set, held under a hash of 64 bits; they meet again in the result.
- A census counts each shingle's documents. Three quarters of the shingles of a set with a similar set occur in that
  one as well, so sets with fewer shingles seen elsewhere are done. It holds shingles by some ten bits more than
  tell them apart, as a chance match only lets a set through.
- A census counts each signature's sets. Those with one are dropped, those with more than ``GROUP`` are dealt out in
  groups of about that many.
- Each set is first compared with one other, of those it shares a signature with the one whose signatures occur most
  often: in a crowd of near copies that is what they are copies of. Sets outside the largest component of a group are
  then compared with a few others of it, ``TURNS`` times. At last all pairs that share a signature and are not in one
  component yet are compared, each once, across the groups of a dealt-out signature as well: all sets outside its
  largest component, in blocks, against all. So no pair of similar sets is lost, and a crowd costs few pairs.
- Before a pair is compared, a sketch is: for each of some four places a shingle, whether an odd number of shingles falls on
  it. Sets differ in at least as many shingles as their sketches do in places, so most pairs that are too far
  apart go at that; none that is similar does.
- Sets and sketches are read from memory-mapped files in the shared folder.

Defined cases: a document without words or text has an empty set, linked with nothing; fewer words than a shingle are
one; a null doc_id comes after all others and only its own component if nothing else is in it; repeated rows have one set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import GOLDEN, mix64, pieces, staged, text_of, texts
from lendlens.operators.components import components
from lendlens.llm.files import mapped, new_folder, pack_numbers, unpack_numbers, write_whole
from lendlens.llm.minimisers import gram_hashes
from lendlens.llm.sorted_files import ADD_UP, BLOBS, SortedFiles, added, blob_batch, blobs, bounds, sizes_of, unpacked

SHINGLE = 5
#: Similar: PERCENT * union <= 100 * intersection.
PERCENT = 75
PARTS = 4
SEEDS = 16
GROUP = 1024
#: One group in so many is looked at before all pairs that meet are compared, and how often that is done.
LOOK = 16
TURNS = 2
BATCH_BYTES = 8 << 20
#: Bytes of packed sets in a file of the store.
FILE_BYTES = 4 << 20
LAST = 2**63 - 1
SETS = "doc_id long, key long, n_shingles long, one long, two long, shingles binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_sets(batch: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes."""
    words: list[bytes] = []
    ends = []
    for text in batch:
        words += text.lower().split()
        ends.append(len(words))
    symbols = np.fromiter(map(_Hashes().__getitem__, words), np.uint64, len(words))
    grams = gram_hashes(symbols, SHINGLE)
    out, start = [], 0
    for end in ends:
        n = end - start
        if n >= SHINGLE:
            out.append(np.unique(grams[start : end - SHINGLE + 1]))
        elif n:
            out.append(mix64(gram_hashes(symbols[start:end], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def _coarse(hashes: np.ndarray, bits: int) -> np.ndarray:
    shift = np.uint64(64 - bits)
    return hashes >> shift << shift


def _count(keys_of, ranges: int):
    """Counts of the sorted distinct keys that ``keys_of`` finds in batches."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for found in keys_of(batches):
            k, c = np.unique(found, return_counts=True)
            keys.append(k)
            counts.append(c)
            size += len(k)
            if size > ADD_UP:
                yield blobs(*added(keys, counts), ranges)
                keys, counts, size = [], [], 0
        yield blobs(*added(keys, counts), ranges)

    return counted


def _census(rows: DataFrame, keys_of, ranges: int, name: str) -> SortedFiles:
    """The keys that come twice or more, with their counts."""
    folder = new_folder(rows.sparkSession, name)

    def written(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        keys, counts = unpacked(table)
        again = counts > 1
        SortedFiles.write(folder, number, keys[again], counts[again])
        return pa.table({"range": pa.array([number], pa.int32()), "n": [int(again.sum())]})

    sent = rows.mapInArrow(_count(keys_of, ranges), BLOBS)
    made = staged(sent.groupBy("range").applyInArrow(written, "range int, n long")).collect()  # a row for each range
    return SortedFiles(folder, sizes_of([(r["range"], r["n"]) for r in made], ranges))


def _found_in(files: SortedFiles, keys: np.ndarray) -> np.ndarray:
    """The count of each key, 0 if it isn't there."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return files.look_up(distinct)[1][inverse]


def _shingles_of(bits: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            yield _coarse(np.concatenate(shingle_sets(texts(batch.column("text")))), bits)

    return keys


def _describe(files: SortedFiles, bits: int):
    """A row for each document; the shingles only where three quarters of them occur elsewhere."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            sets = shingle_sets(texts(batch.column("text")))
            flat = np.concatenate(sets)
            sizes = np.array([len(x) for x in sets], np.int64)
            ends = np.cumsum(sizes)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat ^ np.uint64(salt)))]) for salt in (0, int(GOLDEN))]
                one, two = ((x[ends] - x[ends - sizes]).view(np.int64) for x in sums)
            again = np.concatenate([[0], np.cumsum(_found_in(files, _coarse(flat, bits)) > 1)])
            elsewhere = again[ends] - again[ends - sizes]
            stays = (sizes > 0) & (100 * elsewhere >= PERCENT * sizes)
            packed = [pack_numbers(x) if keep else None for x, keep in zip(sets, stays.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes), pa.array(one), pa.array(two), pa.array(packed, pa.binary())],
                ["doc_id", "key", "n_shingles", "one", "two", "shingles"],
            )

    return described


@lru_cache(maxsize=1)
def _bands() -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest size of each band."""
    low, high = [], []
    start = 1
    while start < 1 << 40:
        end = start * 100 // PERCENT
        low.append(start)
        high.append(end)
        start = end + 1
    return np.array(low, np.int64), np.array(high, np.int64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, signature) of all signatures of the sets, none of them twice for a set."""
    low, high = _bands()
    sizes = np.array([len(x) for x in sets], np.int64)
    band = np.searchsorted(low, sizes, "right") - 1
    numbers, found = [], []
    for step in (0, 1):
        j = band + step
        # In the next band only sets that are large enough for its smallest size.
        open_ = np.flatnonzero((sizes > 0) & (100 * sizes >= PERCENT * low[j]))
        for seed in range(SEEDS):
            if not len(open_):
                break
            number, signature, safe = _of_seed([sets[i] for i in open_.tolist()], j[open_], high[j[open_]], seed)
            numbers.append(open_[number])
            found.append(signature)
            open_ = open_[~safe]
        for i in open_.tolist():  # safe with no seed: each shingle is a signature
            numbers.append(np.full(sizes[i], i))
            found.append(mix64(sets[i] + mix64(j[i : i + 1].astype(np.uint64))))
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(numbers), np.concatenate(found)


def _of_seed(sets: list[np.ndarray], j: np.ndarray, largest: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures for instance ``j`` by one hash of the domain, and which sets are safe with it."""
    sizes = np.array([len(x) for x in sets], np.int64)
    most = 2 * largest * (100 - PERCENT) // (100 + PERCENT)  # differences of any two sets of the instance
    least = most // 2 + 1
    # Some partitions more than the least number, so that sets are safe though some are nearly empty.
    partitions = np.where(most == 0, 1, np.where(least < 4, least, least + least // 8 + 1))
    # A set differs from a similar one of the instance in no more than its own size allows.
    own = (sizes + np.minimum(largest, 100 * sizes // PERCENT)) * (100 - PERCENT) // (100 + PERCENT)
    must = own // 2 + 1
    of = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    with np.errstate(over="ignore"):
        salt = mix64(j.astype(np.uint64) * np.uint64(1009) + np.uint64(seed + 1))
        place = mix64(flat ^ salt[of])
        first = (place >> np.uint64(16)) % partitions[of].astype(np.uint64)
        part = place % np.uint64(PARTS)
        cells = PARTS * partitions
        begin = np.cumsum(cells) - cells
        cell = begin[of] + (first * np.uint64(PARTS) + part).astype(np.int64)
        total = int(cells.sum())
        count = np.bincount(cell, minlength=total).reshape(-1, PARTS)
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, cell, mix64(flat + salt[of]))
        sums = sums.reshape(-1, PARTS)
        whole, whole_count = sums.sum(axis=1, dtype=np.uint64), count.sum(axis=1)
        left, left_count = whole[:, None] - sums, whole_count[:, None] - count
        owner = np.repeat(np.arange(len(sets)), partitions)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(partitions) - partitions, partitions)
        # Without differences, the whole set is its one signature.
        exact = most[owner] == 0
        left[exact, 0], left_count[exact, 0] = whole[exact], whole_count[exact]
        left_count[exact, 1:] = 0
        where = mix64(salt[owner] + index.astype(np.uint64))
        signature = mix64(left + mix64(where[:, None] + np.arange(PARTS, dtype=np.uint64)))
    robust = ((count > 0).sum(axis=1) >= 2) | exact
    safe = np.bincount(owner, weights=robust, minlength=len(sets)) >= np.where(most == 0, 1, must)
    row, column = np.nonzero(left_count > 0)
    return owner[row], signature[row, column], safe


def _sets_in(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    return batch.column("set_id").to_numpy(), [unpack_numbers(x.as_py(), 1)[0] for x in batch.column("shingles")]


def _signatures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in pieces(batches, "shingles", BATCH_BYTES // 4):
        yield signatures([unpack_numbers(x.as_py(), 1)[0] for x in batch.column("shingles")])[1]


class Store:
    """Sets by their ID, in memory-mapped files."""

    def __init__(self, folder: str, files: int):
        self.folder, self.files, self.present = folder, files, []

    @staticmethod
    def write(folder: str, number: int, ids: np.ndarray, sets: list[np.ndarray]) -> None:
        order = np.argsort(ids)
        ends = np.cumsum([0, *(len(sets[i]) for i in order.tolist())])
        parts = [sets[i].tobytes() for i in order.tolist()]
        write_whole(f"{folder}/{number:08d}", np.array([len(ids)], np.int64).tobytes(), ids[order].tobytes(), ends.astype(np.int64).tobytes(), *parts)

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds(self.files), mix64(ids.astype(np.uint64)), "right")

    def labels(self, ids: np.ndarray) -> np.ndarray:
        """The one number that is held for each ID, or the ID itself; ``ids`` are sorted."""
        out = ids.copy()
        numbers = self.numbers(ids)
        for number in np.intersect1d(numbers, self.present).tolist():
            mine = np.flatnonzero(numbers == number)
            held, _, values = _open(f"{self.folder}/{number:08d}")
            at = np.searchsorted(held, ids[mine])
            at[at == len(held)] = 0
            hit = held[at] == ids[mine]
            out[mine[hit]] = values[at[hit]].view(np.int64)
        return out

    def many(self, ids: np.ndarray) -> list[np.ndarray]:
        """What is held for each ID; all must be there."""
        out: list = [None] * len(ids)
        numbers = self.numbers(ids)
        for number in np.unique(numbers).tolist():
            mine = np.flatnonzero(numbers == number)
            held, ends, values = _open(f"{self.folder}/{number:08d}")
            at = np.searchsorted(held, ids[mine])
            for i, a, b in zip(mine.tolist(), ends[at].tolist(), ends[at + 1].tolist(), strict=True):
                out[i] = values[a:b]
        return out

    def get(self, id: int) -> np.ndarray:
        number = int(self.numbers(np.array([id], np.int64))[0])
        ids, ends, shingles = _open(f"{self.folder}/{number:08d}")
        i = int(np.searchsorted(ids, id))
        return shingles[ends[i] : ends[i + 1]]


@lru_cache(maxsize=4096)
def _open(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = mapped(uri)
    n = int(raw[:8].view(np.int64)[0])
    return raw[8 : 8 + 8 * n].view(np.int64), raw[8 + 8 * n : 16 + 16 * n].view(np.int64), raw[16 + 16 * n :].view(np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The size of a set, then whether an odd number of its shingles falls on each of so many places, as bits."""
    places = 64
    while places < 4 * len(shingles):
        places *= 2
    odd = np.bincount((shingles % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.concatenate([np.array([len(shingles)], np.uint64), np.packbits(odd.astype(np.uint8)).view(np.uint64)])


class Sketches:
    """Sketches of sets, by their place in ``ids``. Each place where two differ is a difference of the sets."""

    def __init__(self, store: Store, ids: np.ndarray):
        found = store.many(ids)
        self.sizes = np.array([x[0] for x in found], np.int64)
        self.bits = [x[1:] for x in found]
        self.words = np.array([len(x) for x in self.bits], np.int64)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _level(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of so many words, those of twice as many folded, and the row of each set."""
        if words not in self.levels:
            own, twice = np.flatnonzero(self.words == words), np.flatnonzero(self.words == 2 * words)
            rows = [self.bits[i] for i in own.tolist()]
            rows += [self.bits[i][:words] ^ self.bits[i][words:] for i in twice.tolist()]
            at = np.full(len(self.words), -1, np.int64)
            at[own], at[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            self.levels[words] = np.stack(rows), at
        return self.levels[words]

    def may_be_similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False only for pairs that differ in more than similar sets can."""
        small, large = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        out = 100 * small >= PERCENT * large
        words = np.minimum(self.words[a], self.words[b])
        for level in np.unique(words[out]).tolist():
            matrix, at = self._level(level)
            mine = np.flatnonzero(out & (words == level))
            step = max(1, (8 << 20) // (8 * level))
            for i in range(0, len(mine), step):
                part = mine[i : i + step]
                differ = np.bitwise_count(matrix[at[a[part]]] ^ matrix[at[b[part]]]).sum(axis=1, dtype=np.int64)
                out[part] = (100 + PERCENT) * differ <= (100 - PERCENT) * (small[part] + large[part])
        return out


def _store(sets: DataFrame) -> tuple[Store, Store]:
    """The shingles and the sketches of sets, from set_id and shingles (packed)."""
    total = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0
    files = int(max(8, total // FILE_BYTES + 1))
    store, sketches = (Store(new_folder(sets.sparkSession, name), files) for name in ("shingle-sets", "sketches"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = pa.array(store.numbers(batch.column("set_id").to_numpy()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([number, batch.column("set_id"), batch.column("shingles")], ["number", "set_id", "shingles"])

    def written(table: pa.Table) -> pa.Table:
        number = table.column("number")[0].as_py()
        found = [unpack_numbers(x.as_py(), 1)[0] for x in table.column("shingles")]
        ids = table.column("set_id").to_numpy()
        Store.write(store.folder, number, ids, found)
        Store.write(sketches.folder, number, ids, [sketch(x) for x in found])
        return pa.table({"number": pa.array([number], pa.int32()), "n": [len(found)]})

    rows = sets.select("set_id", "shingles").mapInArrow(numbered, "number int, set_id long, shingles binary")
    staged(rows.groupBy("number").applyInArrow(written, "number int, n long"))
    return store, sketches


def _verify(store: Store):
    """Of pairs a, b those whose sets are similar."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def get(id: int) -> np.ndarray:
            found = sets.get(id)
            if found is None:
                if len(sets) >= 4096:
                    sets.clear()
                found = sets[id] = store.get(id)
            return found

        for batch in batches:
            similar = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = get(a), get(b)
                close = 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y))
                if close:
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    common = int((x[at] == y).sum())
                    close = 100 * common >= PERCENT * (len(x) + len(y) - common)
                similar.append(close)
            yield batch.filter(pa.array(similar, pa.bool_()))

    return verified


def _links(pairs: DataFrame, store: Store, parts: int) -> DataFrame:
    """Verify pairs, dealt so that those of one set lie together and a frequent one in several tasks.

    The number of parts is given: pairs are few bytes and much work, and would be put together by their bytes.
    """
    dealt = pairs.select("a", "b").repartitionByRange(parts, "b", "a")
    return staged(dealt.mapInArrow(_verify(store), "a long, b long"))


def _send(files: SortedFiles, buckets: int, group: int):
    """Blobs of (signature and group, set, how often its signatures occur in others), and with range -1 those of the
    signatures that are dealt out in groups."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "shingles", BATCH_BYTES // 4):
            ids, sets = _sets_in(batch)
            number, signature = signatures(sets)
            counts = _found_in(files, signature)
            degree = np.bincount(number, weights=np.maximum(counts - 1, 0), minlength=len(sets)).astype(np.int64)
            keep = counts > 1
            number, signature, salts = number[keep], signature[keep], -(-counts[keep] // group)
            id = ids[number]
            salts = salts.astype(np.uint64)
            salt = mix64(id.astype(np.uint64) + signature) % salts
            with np.errstate(over="ignore"):
                key = np.where(salts > 1, mix64(signature + salt * GOLDEN), signature)
            order = np.argsort(key, kind="stable")
            cuts = [0, *np.searchsorted(key[order], bounds(buckets)).tolist(), len(key)]
            rows = []
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                part = order[a:b]
                if len(part):
                    rows.append((i, len(part), pack_numbers(key[part], id[part], degree[number[part]])))
            yield blob_batch(rows)
            many = np.flatnonzero(salts > 1)
            if len(many):
                many = many[np.argsort(signature[many], kind="stable")]
                yield blob_batch([(-1, len(many), pack_numbers(signature[many], id[many], salt[many], salts[many]))])

    return sent


def _gather(folder: str):
    """Write the groups of a range to a file. Of each set the best known of those it meets there: a, b and b's degree.

    One group in ``LOOK`` is looked at: sets that are close meet in a good part of their groups.
    """

    def gathered(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        parts = [unpack_numbers(x.as_py(), 3) for x in table.column("data")]
        key, id, degree = (np.concatenate([p[i] for p in parts]) for i in range(3))
        id, degree = id.view(np.int64), degree.view(np.int64)
        order = np.lexsort((id, -degree, key))
        key, id, degree = key[order], id[order], degree[order]
        write_whole(f"{folder}/{number:08d}", np.array([len(key)], np.int64).tobytes(), key.tobytes(), id.tobytes())
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lead = np.repeat(first, np.diff(np.concatenate([first, [len(key)]])))
        other = np.flatnonzero((id != id[lead]) & (key % np.uint64(LOOK) == 0))
        a, b, w = id[other], id[lead[other]], degree[lead[other]]
        order = np.lexsort((b, -w, a))
        a, b, w = a[order], b[order], w[order]
        best = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else order
        # The first row tells of the file.
        found = {"a": np.append(0, a[best]), "b": np.append(0, b[best]), "w": np.append(-1, w[best])}
        return pa.table({"range": pa.array(np.full(len(best) + 1, number, np.int32)), **found})

    return gathered


def _pair_batch(sketches: Store, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs of places in ``ids``, which are sorted, that may be similar; the smaller ID first."""
    n = max(len(ids), 1)
    both = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    used, places = np.unique(np.concatenate([both // n, both % n]), return_inverse=True)
    a, b = places[: len(both)], places[len(both) :]
    ids = ids[used]
    if len(both):
        close = Sketches(sketches, ids).may_be_similar(a, b)
        a, b = a[close], b[close]
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])


def _suggested(label: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """For each member outside the largest component, one of the largest and one of any other, by places."""
    kinds, part, counts = np.unique(label, return_inverse=True, return_counts=True)
    largest = part == np.argmax(counts)
    few = np.flatnonzero(~largest)
    one = rng.choice(np.flatnonzero(largest), len(few))
    two = rng.integers(0, len(label), len(few))
    a, b = np.concatenate([few, few]), np.concatenate([one, two])
    apart = label[a] != label[b]
    return a[apart], b[apart]


def _across_components(folder: str, labels: Store, sketches: Store, turn: int | None = None):
    """Of the groups in the files of ranges, the pairs of sets that may be similar and whose components differ: all, or in a
    ``turn`` some."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("range").to_pylist():
                raw = mapped(f"{folder}/{number:08d}")
                n = int(raw[:8].view(np.int64)[0])
                key, id = raw[8 : 8 + 8 * n].view(np.uint64), raw[8 + 8 * n :].view(np.int64)
                ids, places = np.unique(id, return_inverse=True)
                label = labels.labels(ids)[places]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
                last = np.concatenate([first[1:], [n]])
                mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first) if n else first.astype(bool)
                if turn is not None:
                    mixed &= key[first] % np.uint64(LOOK) == turn
                rng = np.random.default_rng(number)
                left, right, size = [], [], 0
                for i in np.flatnonzero(mixed).tolist():
                    members, parts = places[first[i] : last[i]], label[first[i] : last[i]]
                    if turn is None:
                        a, b = np.triu_indices(len(members), 1)
                        apart = parts[a] != parts[b]
                        a, b = a[apart], b[apart]
                    else:
                        a, b = _suggested(parts, rng)
                    left.append(members[a])
                    right.append(members[b])
                    size += len(a)
                    if size > ADD_UP:
                        yield _pair_batch(sketches, ids, np.concatenate(left), np.concatenate(right))
                        left, right, size = [], [], 0
                if size:
                    yield _pair_batch(sketches, ids, np.concatenate(left), np.concatenate(right))

    return found


def _unpack_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data"):
            columns = [x.view(np.int64) for x in unpack_numbers(data.as_py(), 4)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["signature", "set_id", "salt", "salts"])


def _across_blocks(sketches: Store):
    """Pairs that may be similar, across components, of a block of sets outside the largest component and a block of all."""

    def found(table: pa.Table) -> pa.Table:
        id, part, side = (table.column(c).to_numpy() for c in ("set_id", "component", "side"))
        few, every = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = np.repeat(few, len(every)), np.tile(every, len(few))
        apart = part[a] != part[b]
        ids, place = np.unique(id, return_inverse=True)
        return pa.Table.from_batches([_pair_batch(sketches, ids, place[a[apart]], place[b[apart]])])

    return found


def _across_groups(many: DataFrame, labels: DataFrame, sketches: Store) -> DataFrame:
    """Pairs across components of the signatures that were dealt out in groups."""
    rows = many.join(labels.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
    rows = staged(rows.withColumn("component", F.coalesce("component", "set_id")))
    sizes = rows.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("signature").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("kinds"))
    rows = staged(rows.join(staged(largest.where("kinds > 1")), "signature"))
    few = rows.where("component <> largest")
    blocks = staged(few.select("signature", F.col("salt").alias("few_salt")).distinct())
    every = rows.join(blocks, "signature").select("signature", "few_salt", "salt", "set_id", "component", F.lit(False).alias("side"))
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    fanned = few.select("signature", F.col("salt").alias("few_salt"), "set_id", "component", salt)
    both = every.unionByName(fanned.withColumn("side", F.lit(True)))
    return both.groupBy("signature", "few_salt", "salt").applyInArrow(_across_blocks(sketches), "a long, b long")


def _label_store(labels: DataFrame, files: int) -> Store:
    """The component of each set that has one."""
    store = Store(new_folder(labels.sparkSession, "components"), files)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = pa.array(store.numbers(batch.column("node").to_numpy()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([number, batch.column("node"), batch.column("component")], ["number", "node", "component"])

    def written(table: pa.Table) -> pa.Table:
        number = table.column("number")[0].as_py()
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        Store.write(store.folder, number, node, [x.view(np.uint64) for x in component[:, None]])
        return pa.table({"number": pa.array([number], pa.int32()), "n": [len(node)]})

    rows = labels.mapInArrow(numbered, "number int, node long, component long")
    made = staged(rows.groupBy("number").applyInArrow(written, "number int, n long"))
    store.present = sorted(r["number"] for r in made.collect())  # a row for each file
    return store


def _ties(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components that links tie, as a, b."""
    one, two = labels.alias("one"), labels.alias("two")
    named = links.alias("l").join(one, F.col("l.a") == F.col("one.node")).join(two, F.col("l.b") == F.col("two.node"))
    return named.select(F.col("one.component").alias("a"), F.col("two.component").alias("b")).where("a <> b").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, component with each component put to the largest one it is tied to, if that is larger, and on from there.

    Components that are tied may still have several names after that, but never one name if they aren't.
    """
    sizes = staged(labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    ties = staged(_ties(labels, links))
    both = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own, other = sizes.alias("own"), sizes.alias("other")
    sized = both.join(own, F.col("a") == F.col("own.component")).join(other, F.col("b") == F.col("other.component"))
    up = sized.where("other.n > own.n OR (other.n = own.n AND b < a)")
    top = F.max(F.struct(F.col("other.n").alias("n"), F.bitwise_not("b").alias("b")))["b"]
    ahead = staged(up.groupBy("a").agg(F.bitwise_not(top).alias("b")))
    for _ in range(2):
        further = ahead.alias("x").join(ahead.alias("y"), F.col("x.b") == F.col("y.a"), "left")
        ahead = staged(further.select("x.a", F.coalesce("y.b", "x.b").alias("b")))
    joined = labels.join(ahead, labels["component"] == ahead["a"], "left")
    return staged(joined.select("node", F.coalesce("b", "component").alias("component")))


NUMBERS = ["one", "two", "n_shingles"]


def similar_documents(docs: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(id, key, doc_id and the numbers of its set for each document; the numbers, component and component_id of the sets
    of two documents or with a similar set). The other documents are linked with nothing.

    ``id`` orders documents, null doc_ids last, and with ``key`` finds a row again; ``component`` is a name of the component.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    bits = min(64, int(total).bit_length() + 10)
    files = _census(rows.select("text"), _shingles_of(bits), max(8, rows.rdd.getNumPartitions()), "shingles")
    keyed = rows.withColumn("key", F.xxhash64("text"))
    described = staged(keyed.mapInArrow(_describe(files, bits), SETS))
    described = described.withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    classes = described.where("n_shingles > 0").groupBy(*NUMBERS).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    classes = staged(classes.withColumn("set_id", F.xxhash64(*NUMBERS)))
    candidates = described.where("shingles is not null").select(F.xxhash64(*NUMBERS).alias("set_id"), "shingles")
    sets = staged(candidates.groupBy("set_id").agg(F.first("shingles").alias("shingles")))
    store, sketches = _store(sets)
    packed = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0
    ranges = int(max(8, packed // (FILE_BYTES // 4) + 1))
    signed = _census(sets.select("shingles"), _signatures_of, ranges, "signatures")
    sent = staged(sets.mapInArrow(_send(signed, ranges, group), BLOBS))
    folder = new_folder(docs.sparkSession, "signature-groups")
    met = staged(sent.where("range >= 0").groupBy("range").applyInArrow(_gather(folder), "range int, a long, b long, w long"))
    ranges_met = met.where("w < 0").select("range").repartition(ranges, "range")
    # First each set with the best known one it meets: of a crowd of near copies that ties most.
    best = met.where("w >= 0").groupBy("a").agg(F.max(F.struct("w", "b"))["b"].alias("b"))
    links = _links(best, store, ranges)
    labels = staged(sets.select(F.col("set_id").alias("node"), F.col("set_id").alias("component")))
    labels = _merged(labels, links)
    # Then those left over with some they meet, of other components.
    for turn in range(1, TURNS + 1):
        found = _across_components(folder, _label_store(labels, store.files), sketches, turn)
        some = _links(ranges_met.mapInArrow(found, "a long, b long").distinct(), store, ranges)
        labels, links = _merged(labels, some), links.unionByName(some)
    # At last all pairs that meet and are not in one component yet.
    found = _across_components(folder, _label_store(labels, store.files), sketches)
    pairs = ranges_met.mapInArrow(found, "a long, b long")
    many = sent.where("range < 0").select("data")
    if not many.isEmpty():
        many = staged(many.mapInArrow(_unpack_many, "signature long, set_id long, salt long, salts long"))
        pairs = pairs.unionByName(_across_groups(many, labels, sketches))
    links = links.unionByName(_links(pairs.distinct(), store, ranges))
    tied = components(_ties(labels, links)).select(F.col("node").alias("name"), F.col("component").alias("whole"))
    labels = labels.join(tied, labels["component"] == tied["name"], "left")
    labels = labels.select(F.col("node").alias("set_id"), F.coalesce("whole", "component").alias("component"))
    joined = classes.join(labels, "set_id", "left").where("n > 1 or component is not null")
    joined = staged(joined.select(*NUMBERS, "first_id", F.coalesce("component", "set_id").alias("component")))
    least = staged(joined.groupBy("component").agg(F.min("first_id").alias("component_id")))
    return described, staged(joined.join(least, "component").select(*NUMBERS, "component", "component_id"))


def report(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    described, groups = similar_documents(docs, group)
    component = F.coalesce(F.nullif("component_id", F.lit(LAST)), "doc_id")
    return described.select("doc_id", *NUMBERS).join(groups, NUMBERS, "left").select("doc_id", "n_shingles", component.alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with the columns of ``docs``; of rows that repeat doc_id
    and text one."""
    described, groups = similar_documents(docs)
    members = staged(described.select("id", "key", *NUMBERS).join(groups, NUMBERS).select("id", "key", "component"))
    stays = staged(members.groupBy("component").agg(F.min(F.struct("id", "key")).alias("stays")))
    gone = members.join(stays, "component").where("id <> stays.id or key <> stays.key").select("id", "key")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_of()).alias("key"))
    return rows.join(staged(gone), ["id", "key"], "left_anti").dropDuplicates(["id", "key"]).select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id
GROUP BY w.doc_id
"""
