import base64
import gzip
import hashlib
import json
import os
from collections import defaultdict

import pytest

from lendlens.llm import warc
from lendlens.llm.files import new_folder

SCHEMA = "page_id long, url string, html string, n_chars string"


def pages():
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (1 + i % 3), "x") for i in range(60)]
    rows += [(100 + i, "http://copies/ a\r\nb", "<b>same</b>\r\n\r\nWARC/1.1\r\n", "x") for i in range(50)]
    rows += [(200, None, None, "x"), (201, "u", "", "x"), (202, "ü", "é日\x00" * 400_000, "x")]
    return rows + [(None, "n", "only null", "x"), (None, "n", "only null", "x"), (None, "n", "<b>same</b>\r\n\r\nWARC/1.1\r\n", "x"), (203, "r", "r", "x"), (203, "r", "r", "x")]


def wanted(rows, least=0):
    groups = defaultdict(list)
    for page_id, _, html, _ in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for data, ids in groups.items():
        winner = max((i for i in ids if i is not None), default=None) if len(data) >= least else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for i in ids:
            refers = winner if winner is not None and i != winner and len(ids) > 1 else None
            out.append((i, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_report(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    assert found(warc.report(df)) == wanted(pages())
    assert warc.report(df.limit(0)).count() == 0


def test_small_payloads_are_responses(spark):
    rows = warc.with_revisits(spark.createDataFrame(pages(), SCHEMA), least=20)
    assert found(warc.read_records(warc.normalise(warc.write_archives(rows)))) == wanted(pages(), 20)


def local(uri):
    return "/" + uri.removeprefix("file:").lstrip("/")


def test_each_record_is_a_member_at_its_place(spark):
    archives = warc.write_archives(warc.with_revisits(spark.createDataFrame(pages(), SCHEMA).repartition(2)))
    for path, _ in archives.collect():
        made, index, n = warc.normalise_file(path, f"{path}.members")
        data = open(local(made), "rb").read()
        entries = [json.loads(x) for x in open(local(index), "rb").read().splitlines()]
        parts = [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in entries]
        assert len(parts) == n and sum(e["length"] for e in entries) == len(data)
        assert b"".join(parts) == gzip.decompress(open(local(path), "rb").read())
        # Normalising again changes nothing but the file's name.
        again, _, _ = warc.normalise_file(made, f"{path}.again")
        assert open(local(again), "rb").read() == data


def write(spark, data):
    folder = new_folder(spark, "warc-test")
    os.makedirs(local(folder))
    with open(f"{local(folder)}/a.warc.gz", "wb") as file:
        file.write(data)
    return f"{folder}/a.warc.gz"


def test_broken_archives_stop_with_their_name(spark):
    whole = gzip.compress(warc.record(1, "u", b"x" * 5000, None))
    for data in (whole[:-30], gzip.compress(b"no record\r\n\r\n"), gzip.compress(warc.record(1, "u", b"x" * 5000, None)[:-300]), b"plain"):
        path = write(spark, data)
        with pytest.raises(ValueError, match="a.warc.gz"):
            warc.normalise_file(path, f"{path}.members")
    path = write(spark, gzip.compress(b""))
    assert warc.normalise_file(path, f"{path}.members")[2] == 0


def test_a_payload_that_has_changed_is_found():
    member = gzip.compress(warc.record(1, "u", b"good", None).replace(b"good", b"evil"))
    with pytest.raises(ValueError, match="digest"):
        warc.read_member(member)
