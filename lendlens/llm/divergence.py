"""An audit of how the sources of a language differ in their terms, over terms packed into words by their length.

A term is a run of letters: ASCII letters, of which A-Z are lower-cased, and all characters beyond ASCII. Terms of up to 8
bytes are one uint64, those of up to 16 bytes two, first byte highest, so that the numbers are in the order of the bytes.
A batch of texts gives three classes of terms. The two short ones are radix-sorted in numpy by (term, group), 16 bits at a
time, a group being a (lang, source); the runs are counted, rows at a time for the number of documents. Long terms are sorted
as bytes in a bucket of their own. No term is a Python object but the long ones.

Tasks send the counted runs to buckets by a hash of the term, packed: one binary row for each task, bucket and class. A
bucket holds a fixed share of the text whatever a term's frequency, as a task has counted a term before it goes. Bucket tasks
sort and add up the same way, find the terms of each language in ``LEAST`` documents, and give those alone back. That is the
one shuffle of all terms.

The divergence of two groups is summed over all kept terms, those that occur in neither too: buckets of kept terms meet the
totals of all groups of their language, and a block of terms by sources is one matrix. Sources take part in blocks of
``SOURCES``, so a matrix has a bounded size for any number of them. Sums by pair are added up in Spark.

All arithmetic is of integers; p, at most 10^9 + 1, comes from a long division by three digits at a time, which holds for
groups of up to 9 * 10^15 terms.

Defined cases: a null text, lang or source counts as the empty string, which is a language or source like any other; each row
is a document of its own, also one that repeats another or has no doc_id; a group without terms has all counts zero; a
language with one source has no pairs; a language without kept terms has pairs of value 0 and no terms; an empty table
gives no rows; a text longer than a batch is a batch by itself. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.common import GOLDEN, mix64, pieces, staged, text_of
from lendlens.llm.files import pack_numbers, unpack_numbers
from lendlens.llm.spans import pack_parts, unpack_parts

#: A kept term occurs in so many documents of its language.
LEAST = 10
SCALE = 1_000_000_000
TOP = 10
#: Bytes of text that a batch, and that a bucket, is made of.
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Parts that the kept terms of a bucket are paired in.
SLICES = 8
#: Sources in a block, and entries of a matrix at a time.
SOURCES = 512
ENTRIES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True

#: The classes: one word, two words, bytes.
CLASSES = 3


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by several columns of whole numbers, the last the most significant, sorted 16 bits at a time."""
    order = None
    for key in keys:
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if not len(digit) or digit.min() == digit.max():
                continue
            step = np.argsort(digit if order is None else digit[order], kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(keys[0])) if order is None else order


def starts_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes, the first row too."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class Found:
    """The terms of a batch of texts: where they start, how long they are, and whose they are."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        base, stop = int(ends[0]), int(ends[-1])
        raw = np.frombuffer(data, np.uint8, stop - base, base) if stop > base else np.zeros(0, np.uint8)
        # 16 bytes more, so that the words of the last term can be read.
        self.bytes = np.concatenate([_LOWER[raw], np.zeros(16, np.uint8)])
        letter = np.concatenate([[False], _LETTER[self.bytes[: len(raw)]], [False]])
        edge = letter[1:] != letter[:-1]
        inside = ends[1:-1] - base
        both = inside[(inside > 0) & (inside < len(raw))]
        joined = both[letter[both] & letter[both + 1]]  # a text ends in a letter and the next begins with one
        starts = np.flatnonzero(edge & letter[1:])
        stops = np.flatnonzero(edge & letter[:-1])
        self.start = np.sort(np.concatenate([starts, np.unique(joined)]))
        self.length = np.sort(np.concatenate([stops, np.unique(joined)])) - self.start
        self.row = np.searchsorted(ends[1:] - base, self.start, "right").astype(np.uint32)

    def words(self, chosen: np.ndarray, at: int) -> np.ndarray:
        """Bytes ``at`` to ``at + 8`` of the chosen terms as numbers, zero beyond their ends."""
        eight = np.ndarray(len(self.bytes) - 7, ">u8", self.bytes, strides=(1,))
        left = np.clip(self.length[chosen] - at, 0, 8)
        place = np.minimum(self.start[chosen] + at, len(eight) - 1)
        cut = ((8 - left) * 8).astype(np.uint64)
        whole = eight[place].astype(np.uint64)
        return np.where(left > 0, whole >> np.minimum(cut, np.uint64(56)) << np.minimum(cut, np.uint64(56)), np.uint64(0))


def _counted(keys: list[np.ndarray], group: np.ndarray, row: np.ndarray) -> tuple:
    """Runs of equal (key columns, group): the keys, group, occurrences and documents. Rows come in their order."""
    order = radix_order(group, *reversed(keys))
    keys, group, row = [k[order] for k in keys], group[order], row[order]
    at = starts_of_runs(*keys, group)
    new = np.zeros(len(row), np.int64)
    new[starts_of_runs(*keys, group, row)] = 1
    times = np.diff(np.append(at, len(row)))
    documents = np.add.reduceat(new, at) if len(at) else new
    return [k[at] for k in keys], group[at], times, documents


def _added(keys: list[np.ndarray], group: np.ndarray, times: np.ndarray, documents: np.ndarray) -> tuple:
    order = radix_order(group, *reversed(keys))
    keys, group = [k[order] for k in keys], group[order]
    at = starts_of_runs(*keys, group)
    if not len(at):
        return keys, group, times, documents
    return [k[at] for k in keys], group[at], np.add.reduceat(times[order], at), np.add.reduceat(documents[order], at)


def _numbered(terms: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct terms in the order of their bytes, and the number of each term among them."""
    distinct = sorted(set(terms))
    place = {t: i for i, t in enumerate(distinct)}
    return distinct, np.fromiter(map(place.__getitem__, terms), np.uint32, len(terms))


def _dealt(keys: list[np.ndarray], buckets: int) -> np.ndarray:
    spread = mix64(keys[0] ^ GOLDEN)
    for k in keys[1:]:
        spread = mix64(spread + (k ^ GOLDEN))
    return (spread % np.uint64(buckets)).astype(np.uint32)


def _blobs(kind: int, bucket: np.ndarray, columns: list[np.ndarray], terms: list[bytes] | None, groups: list[bytes]) -> Iterator[tuple]:
    """(bucket, blob) for each bucket: its part of the columns, of the long terms, and the groups they are of."""
    if not len(bucket):
        return
    order = radix_order(bucket)
    bucket, columns = bucket[order], [c[order] for c in columns]
    at = starts_of_runs(bucket)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
        part = [c[a:b] for c in columns]
        group = part[-3]
        used, local = np.unique(group, return_inverse=True)
        part[-3] = local
        names = b"\n".join([groups[g] for g in used.tolist()])
        held = b""
        if terms is not None:
            these, part[0] = _numbered([terms[i] for i in part[0].tolist()])
            held = b"\n".join(these)
        yield int(bucket[a]), pack_parts(bytes([kind]), names, held, pack_numbers(*part))


def _group_name(lang: str, source: str) -> bytes:
    """A line for a group; a line break or backslash within is escaped."""
    return "\t".join(x.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t") for x in (lang, source)).encode()


def _send(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            found = Found(batch.column("text"))
            names = list(map(_group_name, batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            groups, of_row = _numbered(names)
            group = of_row[found.row]
            rows = []
            for kind, low, high in ((1, 0, 8), (2, 8, 16)):
                chosen = np.flatnonzero((found.length > low) & (found.length <= high))
                keys = [found.words(chosen, 8 * k) for k in range(kind)]
                keys, its, times, documents = _counted(keys, group[chosen], found.row[chosen])
                rows += _blobs(kind, _dealt(keys, buckets), [*keys, its, times, documents], None, groups)
            chosen = np.flatnonzero(found.length > 16)
            ends = (found.start + found.length)[chosen].tolist()
            text = found.bytes.tobytes()
            terms, number = _numbered([text[a:b] for a, b in zip(found.start[chosen].tolist(), ends, strict=True)])
            (number,), its, times, documents = _counted([number], group[chosen], found.row[chosen])
            hashes = np.array([xxhash.xxh3_64_intdigest(t) % buckets for t in terms], np.uint32)
            rows += _blobs(3, hashes[number], [number, its, times, documents], terms, groups)
            if rows:
                bucket, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    return send


def _texts_of(keys: list[np.ndarray]) -> list[str]:
    """Packed terms as text."""
    raw = np.stack(keys, 1).astype(">u8").tobytes()
    size = 8 * len(keys)
    return [raw[a : a + size].rstrip(b"\0").decode() for a in range(0, len(raw), size)]


KEPT = "bucket int, lang string, source string, term string, at int, count long, total long, first boolean"


def _merge(least: int):
    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        opened = [unpack_parts(d) for d in table.column("data").to_pylist()]
        groups = sorted({g for _, names, _, _ in opened for g in names.split(b"\n")})  # those of a language follow each other
        place = {g: i for i, g in enumerate(groups)}
        langs, lang_of = _numbered([g.split(b"\t")[0] for g in groups])
        out: dict[str, list] = {c: [] for c in ("group", "term", "at", "count", "total", "first")}
        known = 0
        for kind in range(1, CLASSES + 1):
            parts, held = [], []
            for head, names, terms, numbers in opened:
                if head[0] != kind:
                    continue
                part = unpack_numbers(numbers, 3 + max(1, kind % 3))
                part[-3] = np.array([place[g] for g in names.split(b"\n")], np.uint32)[part[-3].astype(np.int64)]
                parts.append(part)
                held.append(terms.split(b"\n") if kind == 3 else [])
            if not parts:
                continue
            if kind == 3:
                distinct = sorted({t for terms in held for t in terms})
                number = {t: i for i, t in enumerate(distinct)}
                for part, terms in zip(parts, held, strict=True):
                    part[0] = np.array([number[t] for t in terms], np.uint64)[part[0].astype(np.int64)]
            *keys, group, times, documents = (np.concatenate(c) for c in zip(*parts, strict=True))
            keys, group, times, documents = _added(keys, group, times.astype(np.int64), documents.astype(np.int64))
            lang = lang_of[group]
            at = starts_of_runs(*keys, lang)
            sizes = np.diff(np.append(at, len(group)))
            of = np.repeat(np.arange(len(at)), sizes)
            keep = (np.add.reduceat(documents, at) >= least)[of]
            total = np.add.reduceat(times, at)[of]
            first = np.zeros(len(group), bool)
            first[at] = True
            chosen = [k[keep] for k in keys]
            term = [distinct[i].decode() for i in chosen[0].tolist()] if kind == 3 else _texts_of(chosen)
            out["group"] += group[keep].tolist()
            out["term"] += term
            # Numbers of the kept terms of the bucket, each language's its own.
            out["at"] += (known + np.cumsum(first[keep]) - 1).tolist()
            out["count"] += times[keep].tolist()
            out["total"] += total[keep].tolist()
            out["first"] += first[keep].tolist()
            known = (out["at"][-1] + 1) if out["at"] else 0
        lang, source = zip(*[_group_of(groups[g]) for g in out["group"]], strict=True) if out["group"] else ((), ())
        return pa.table(
            {
                "bucket": pa.array([bucket] * len(lang), pa.int32()),
                "lang": pa.array(lang, pa.string()),
                "source": pa.array(source, pa.string()),
                "term": pa.array(out["term"], pa.string()),
                "at": pa.array(out["at"], pa.int32()),
                "count": pa.array(out["count"], pa.int64()),
                "total": pa.array(out["total"], pa.int64()),
                "first": pa.array(out["first"], pa.bool_()),
            }
        )

    return merge


def _group_of(name: bytes) -> tuple[str, str]:
    lang, source = (
        "\\".join(y.replace("\\n", "\n").replace("\\t", "\t") for y in x.split("\\\\")) for x in name.decode().split("\t")
    )
    return lang, source


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(text_of().alias("text"), text_of("lang").alias("lang"), text_of("source").alias("source"))


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Of each (lang, source) and term that occurs there and is kept in the language: count, and the language's total.

    ``first`` marks one row of each (lang, term); ``bucket`` and ``at`` tell the terms of a language apart.
    """
    rows = _rows(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = rows.mapInArrow(_send(max(8, size // BUCKET_BYTES + 1)), "bucket int, data binary")
    return staged(sent.groupBy("bucket").applyInArrow(_merge(least), KEPT))


def _portion(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * count / whole), exactly: three digits at a time, so that no step passes a long."""
    found, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        found = found * 1000 + F.call_function("div", rest * 1000, whole)
        rest = rest * 1000 % whole
    return found + 1


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, place (from 0 in the language), whole and lang_whole (N + 2 V of the group and the language), terms (V).

    A row for each group that occurs, with terms or without.
    """
    groups = _rows(docs).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"))
    counts = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count_if("first").alias("v"))
    zero = F.lit(0).cast("long")
    filled = groups.join(counts, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v")
    )
    by_lang = Window.partitionBy("lang")
    terms = F.sum("v").over(by_lang)
    return staged(
        filled.select(
            "lang",
            "source",
            (F.row_number().over(by_lang.orderBy("source")) - 1).alias("place"),
            (F.col("n") + 2 * terms).alias("whole"),
            (F.sum("n").over(by_lang) + 2 * terms).alias("lang_whole"),
            terms.alias("terms"),
        )
    )


def _pairs(left: pa.Table, right: pa.Table, sources: int) -> pa.Table:
    """The sums of the terms of one slice of a bucket for the pairs of two blocks of sources.

    ``left``: place, at and p of what occurs; ``right``: the groups of both blocks, with p of a term they don't have, and
    how many terms the slice has in the language. Those that none of these groups has differ by the same in all.
    """
    places = right.column("place").to_numpy()
    order = np.argsort(places)
    places, absent = places[order], right.column("absent").to_numpy()[order]
    block_a, block_b = right.column("block_a")[0].as_py(), right.column("block_b")[0].as_py()
    in_a, in_b = (np.flatnonzero(places // sources == x) for x in (block_a, block_b))
    at, p = left.column("at").to_numpy(), left.column("p").to_numpy()
    who = np.searchsorted(places, left.column("place").to_numpy())
    order = np.argsort(at, kind="stable")
    at, p, who = at[order], p[order], who[order]
    of = np.cumsum(np.diff(at, prepend=at[:1]) != 0)  # terms numbered from 0
    terms = int(of[-1]) + 1 if len(of) else 0
    step = max(1, ENTRIES // len(places))
    one, other = absent[in_a][:, None], absent[in_b][None, :]
    sums = (right.column("terms")[0].as_py() - terms) * ((one - other) * (one - other) // (one + other))
    for start in range(0, terms, step):
        low, high = np.searchsorted(of, [start, start + step])
        width = min(step, terms - start)
        m = np.repeat(absent[:, None], width, 1)
        m[who[low:high], of[low:high] - start] = p[low:high]
        theirs = m[in_b]
        for i, row in enumerate(m[in_a]):
            apart = theirs - row
            sums[i] += (apart * apart // (theirs + row)).sum(1)
    i, j = np.nonzero(places[in_a][:, None] < places[in_b][None, :])
    lang = right.column("lang")[0].as_py()
    return pa.table(
        {
            "lang": pa.array([lang] * len(i), pa.string()),
            "a": pa.array(places[in_a][i], pa.int32()),
            "b": pa.array(places[in_b][j], pa.int32()),
            "value": pa.array(sums[i, j], pa.int64()),
        }
    )


def _in_blocks(df: DataFrame, sources: int) -> DataFrame:
    """A copy of each row for each pair of blocks (block_a <= block_b) that its place takes part in."""
    own = F.floor(F.col("place") / sources).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = df.select("*", own.alias("own"), other)
    return dealt.withColumns({"block_a": F.least("own", "other"), "block_b": F.greatest("own", "other")}).drop("own", "other")


def pair_values(kept: DataFrame, totals: DataFrame, sources: int = SOURCES) -> DataFrame:
    """lang, a, b (places, a < b), value: summed over the kept terms; no row for a language without any."""
    blocks = F.floor(F.max("place").over(Window.partitionBy("lang")) / sources).cast("int") + 1
    numbered = totals.where("terms > 0").withColumn("blocks", blocks)
    kept = kept.withColumn("slice", F.col("at") % SLICES)  # a large language is many groups in a small corpus too
    share = _portion(F.col("count") + 2, F.col("whole"))
    entries = kept.join(numbered, ["lang", "source"]).select("lang", "bucket", "slice", "place", "blocks", "at", share.alias("p"))
    absent = _portion(F.lit(2).cast("long"), F.col("whole"))
    present = kept.groupBy("lang", "bucket", "slice").agg(F.count_if("first").alias("terms"))
    groups = numbered.select("lang", "place", "blocks", absent.alias("absent")).join(present, "lang")
    key = ["lang", "bucket", "slice", "block_a", "block_b"]
    left = _in_blocks(entries, sources).select(*key, "place", "at", "p").groupBy(*key)
    sides = _in_blocks(groups, sources).select(*key, "place", "absent", "terms")
    right = sides.toDF(*sides.columns).groupBy(*key)  # columns of its own: both sides come from ``kept``

    def summed(entries: pa.Table, groups: pa.Table) -> pa.Table:
        return _pairs(entries, groups, sources)

    parts = left.cogroup(right).applyInArrow(summed, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _pair_part(kept: DataFrame, totals: DataFrame) -> DataFrame:
    values = pair_values(kept, totals)
    both = values.select("lang", "a", "b", "value").unionByName(
        values.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    )
    own = totals.select("lang", "source", F.col("place").alias("a"))
    other = totals.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    pairs = own.join(other, "lang").where("a <> b")  # the rows asked for
    found = pairs.join(both, ["lang", "a", "b"], "left")
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def _term_part(kept: DataFrame, totals: DataFrame) -> DataFrame:
    joined = kept.join(totals.select("lang", "source", "whole", "lang_whole"), ["lang", "source"])
    rated = joined.select(
        "lang",
        "source",
        F.col("term").alias("item"),
        _portion(F.col("count") + 2, F.col("whole")).alias("p"),
        _portion(F.col("total") + 2, F.col("lang_whole")).alias("q"),
    ).where("p > q")
    return rated.select("lang", "source", F.lit("term").alias("part"), "item", _difference(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance from the others, and its ``top`` terms."""
    kept = kept_terms(docs, least)
    totals = group_totals(docs, kept)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = _pair_part(kept, totals).withColumn("rank", rank)
    terms = _term_part(kept, totals).withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), v AS (
  SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS n
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) c USING (lang, source, term)
), p AS (
  SELECT c.lang, c.source, c.term, c.n,
    1 + (1000000000::HUGEINT * (c.n + 2)) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (c.total + 2)) // (v.n + 2 * v.v) AS q
  FROM counts c JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
