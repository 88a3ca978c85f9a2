"""Token files and WARC archives."""

import base64
import gzip
import hashlib
import io
import os
import zipfile

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from routelab.llm import queries, storage, token_counts, warc

PATH = P.path("byte_bpe_50k.tiktoken")


def test_token_counts_query(spark, docs):
    counts = {r["doc_id"]: r["n_tokens"] for r in queries.op2_token_counts(spark, "/root/testdata/sf0.001").collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    assert counts == {d["doc_id"]: len(encode(d["text"] or "")) for d in docs.collect()}


@pytest.mark.parametrize("block", [2, 4, 6, 10, 64, 1 << 20])
def test_blocks_stitch(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files, want = [], []
    for k in range(4):
        ids = rng.choice([7, 8, 9, 9, 11], rng.integers(0, 40) if k else 0).astype("<u2")
        if k == 2:
            ids = np.array([9, 9, 1, 9], "<u2")
        uri = f"file://{tmp_path}/{k}"
        storage.write_bytes(uri, [ids.tobytes()])
        files.append((uri, len(ids) * 2))
        start, n = 0, 0
        for at, x in enumerate([*ids.tolist(), None]):
            if x == 9 or (x is None and at > start):
                want.append((uri, n, start, at - start, x == 9))
                start, n = at + 1, n + 1
    got = token_counts.count_tokens(spark.createDataFrame(files, "file string, bytes bigint"), 9, 2, block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_token_files_odd_rows(odd):
    out = token_counts.document_tokens(odd, PATH, P.PATTERN, 50256)
    assert out.count() == odd.count() and {r["n_tokens"] for r in out.filter("doc_id <= 2").collect()} == {0}
    assert token_counts.document_tokens(odd.limit(0), PATH, P.PATTERN, 50256).count() == 0


def test_ids_wider_than_the_file_raise(odd):
    with pytest.raises(ValueError):
        token_counts.write_files(odd, PATH, P.PATTERN, 1 << 16)
    with pytest.raises(ValueError):
        token_counts.write_files(odd, PATH, P.PATTERN, 7, width=1)


def test_warc_query(compare):
    compare(queries.op4_warc_archives, queries.ORACLE_SQL["op4_warc_archives"])


def test_warc_revisits_and_payloads(spark):
    big = "é" * 80
    rows = [(5, "http://a/b\r\nc d", big), (3, None, big), (9, "u", big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", big), (3, "again", big), (6, "u", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'clash' as payload", "0 as n")
    got = warc.archive_and_read(pages).collect()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == sorted([("5", "revisit", 3), ("3", "response", None), ("3", "response", None), ("9", "revisit", 3), ("1", "response", None), ("2", "response", None), ("4", "response", None), ("None", "revisit", 3), ("6", "response", None)])
    for r in got:
        if r["record_type"] == "response":
            assert len(r["payload"]) == r["payload_bytes"] and hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
    assert {r["payload_bytes"] for r in got if r["page_id"] in (3, 5, 9)} == {160}
    assert warc.archive_and_read(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_both_ways(tmp_path, zip64):
    members = [("a.txt", b"alpha"), (warc.DATA, os.urandom(1000)), ("é.txt", b"")]
    raw = b"".join(warc.zip_parts(members, zip64))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    storage.write_bytes(f"file://{tmp_path}/own.zip", [raw])
    with zipfile.ZipFile(tmp_path / "std.zip", "w") as z:
        for n, d in members:
            with z.open(zipfile.ZipInfo(n), "w", force_zip64=zip64) as f:
                f.write(d)
        z.comment = b"PK\5\6 a comment with a signature"
    for name in ("own.zip", "std.zip"):
        with storage.RangeFile(f"file://{tmp_path}/{name}") as f:
            found = warc.central_directory(f)
            assert [(m.name, f.read(warc.data_offset(f, m), m.size)) for m in found] == members
    storage.write_bytes(f"file://{tmp_path}/bad", [b"no archive"])
    with storage.RangeFile(f"file://{tmp_path}/bad") as f, pytest.raises(warc.BadZip):
        warc.central_directory(f)


def test_well_packed_records_come_in_small_batches(spark):
    pages = spark.createDataFrame([(k, "u", f"{k}" + "a" * 300_000) for k in range(40)], "page_id bigint, url string, html string")
    ranges = warc.record_ranges(warc.write_archives(warc.decided(pages.coalesce(1))))
    read = warc.read_records(ranges, 1, 1 << 20).collect()
    assert sorted(r["page_id"] for r in read) == list(range(40)) and all(len(r["payload"]) == r["payload_bytes"] for r in read)


def test_damaged_record():
    raw = warc.record_bytes(1, "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), "response", None)
    assert warc.parse_record(gzip.decompress(gzip.compress(raw)))["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r", b"pAyload\r"))
