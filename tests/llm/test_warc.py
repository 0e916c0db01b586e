import base64
import hashlib
import os
import random
import re

import pytest

from punctual.llm import warc as W
from punctual.llm.queries import ORACLE, QUERIES
from punctual.session import fresh_path
from .util import SF

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
FAKE = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:66:x:y:0>\r\nContent-Type: application/http\r\n"
        "Content-Length: {n}\r\n\r\n{body}\r\n\r\n")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    out, seen = [], {}
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        d = digest(html)
        out.append((page, len((html or "").encode()), d, "revisit" if d in seen else "response", seen.get(d)))
        seen.setdefault(d, page)
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows],
                                 "page_id long, url string, html string, file string, offset string, n string").repartition(4)


def some_pages(n=300):
    r = random.Random(4)
    body = "<p>" + "é word\r\n\r\n" * 40
    rows = [(i, f"http://e.org/{i}", f"<html>{r.random()}{body * r.randint(0, 3)}") for i in range(n)]
    rows += [(1000 + i, "http://e.org/copy", "<html>one copy") for i in range(50)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://e.org/a b\r\nX: 1", "odd url"), (None, "http://n", "no id"),
             (None, "http://n", "no id"), (3, "http://e.org/3", "twice"), (3, "http://e.org/3", "twice"), (3, "u", "twice"),
             (2003, "http://long", "x" * 300_000), (2004, "http://e", "\x00﻿ \U0001F600")]
    # payloads that hold the magic, whole records, false lengths and half a head
    rows += [(3000 + i, "http://fake", "before " + FAKE.format(n=r.choice([0, 1, 4, 10 ** 6, 10 ** 20]), body="fake") * k + "WARC/1.")
             for i, k in enumerate([1, 2, 3, 5, 8, 13])]
    whole = FAKE.format(n=4, body="fake")
    rows += [(3100, "http://fake", whole), (3101, "http://fake", whole * 2), (3102, "u", "WARC/1.1\r\n"), (3103, "u", "WARC/1.")]
    return rows


def parsed(data):
    """Plain sequential reading of one archive."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode()
        assert head.startswith("WARC/1.1\r\n")
        n = int(re.search(r"Content-Length: (\d+)", head)[1])
        block = data[end + 4:end + 4 + n]
        assert data[end + 4 + n:end + 8 + n] == b"\r\n\r\n"
        out.append((at, re.search(r"WARC-Record-ID: <([^>]*)>", head)[1], block[block.index(b"\r\n\r\n") + 4:]))
        at = end + 8 + n
    return out


@pytest.mark.parametrize("range_bytes", [None, 977, 64])
def test_round_trip(spark, range_bytes):
    rows = some_pages(300 if range_bytes is None else 60)
    path = fresh_path(spark, "test-warc")
    W.write_archives(frame(spark, rows), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if range_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes if range_bytes > 64 else 20_011))
        records = W.read_archives(spark, path)
        got = sorted((tuple(r[c] for c in COLUMNS) for r in W.pages_of(records).collect()), key=str)
        assert got == expected(rows)
        if range_bytes is None:
            files = {f: parsed(open(os.path.join(path, f), "rb").read()) for f in os.listdir(path) if f.startswith("part-")}
            want = sorted((f, *r) for f, found in files.items() for r in found)
            payload = {r.record_id: bytes(r.payload) if r.payload is not None else b""
                       for r in W.read_archives(spark, path, True).collect()}
            assert len(want) == len(payload) and {r[2]: r[3] for r in want} == payload
            assert sorted((os.path.basename(r.file), r.offset) for r in records.collect()) == [r[:2] for r in want]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_archives(spark):
    """A file without a record at its start gives none; a chain ends where its successor is no record."""
    path = fresh_path(spark, "test-warc-broken")
    os.makedirs(path.removeprefix("file:"))
    good = FAKE.format(n=22, body="HTTP/1.1 200 OK\r\n\r\nabc").replace("page:66", "page:1")
    for name, text in (("a.warc", "garbage" + good), ("b.warc", good + good.replace(":1:x", ":2:x") + "xx" + good), ("c.warc", "")):
        open(os.path.join(path.removeprefix("file:"), name), "wb").write(text.encode())
    got = [(os.path.basename(r.file), r.record_id, r.payload_bytes) for r in W.read_archives(spark, path).collect()]
    assert sorted(got) == [("b.warc", "urn:page:1:x:y:0", 3), ("b.warc", "urn:page:2:x:y:0", 3)]


def test_empty_table(spark):
    path = fresh_path(spark, "test-warc-empty")
    W.write_archives(frame(spark, []), path)
    assert W.pages_of(W.read_archives(spark, path)).count() == 0


def test_query_equals_plain_python_and_sql(spark):
    import duckdb
    got = sorted((tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_warc"](spark, SF).collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op12_warc']})").fetchall(), key=str) == got
