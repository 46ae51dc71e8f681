from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow.fs as pafs
import zstandard

from ionlake.llm import warc as W


def archive(spark, tmp_path, rows, least=0, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name, value in more.items():
        df = df.selectExpr("*", f"{value} as {name}")
    uri = f"file://{tmp_path}/bundles"
    (tmp_path / "bundles").mkdir()
    index = W.write_archive(df, uri, least_bytes=least)
    return uri, index, W.read_archive(index, uri).collect()


def test_round_trip(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    payloads = ["x" * int(rng.integers(0, 4000)) + chr(int(rng.integers(32, 3000))) for _ in range(60)]
    rows = [(k, f"http://e.org/{k}?a=1 2\n", payloads[int(rng.integers(60))]) for k in rng.permutation(300).tolist()]
    rows += [(1000, None, None), (1001, "u", ""), (1002, "u", "big " * 200_000)]
    uri, index, out = archive(spark, tmp_path, rows)
    by = {r.id: r for r in out}
    assert len(out) == len(rows)
    first = {}
    for k, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", k)
    for k, _, html in rows:
        data = (html or "").encode()
        r = by[k]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if first[html or ""] == k:
            assert r.record_type == "response" and bytes(r.payload) == data and r.refers_to_id is None
        else:
            assert r.record_type == "revisit" and r.payload is None and r.refers_to_id == f"<urn:page:{first[html or '']}>"


def test_bundles_are_seekable_zstandard(spark, tmp_path):
    rows = [(k, "u", f"page {k} " * 5000) for k in range(40)]
    uri, index, _ = archive(spark, tmp_path, rows)
    held = index.collect()
    fs = pafs.LocalFileSystem()
    for name in {r.bundle for r in held}:
        path = f"{tmp_path}/bundles/{name}"
        data = open(path, "rb").read()
        count, _, magic = struct.unpack("<IBI", data[-9:])
        assert magic == W.SEEK_MAGIC and count > 1
        # any Zstandard reader gives all records in order, skipping the table
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == sum(r.bundle == name for r in held)
        reader = W.BundleReader(fs, path)
        for r in held:
            if r.bundle == name:
                fields, http, payload = W.parse_record(reader.frame(r.frame)[r.start : r.start + r.length])
                assert fields["warc-record-id"] == W.record_id(r.id) and payload == rows[r.id][2].encode()


def test_small_payloads_are_all_responses(spark, tmp_path):
    _, _, out = archive(spark, tmp_path, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], least=3)
    assert {r.id: r.record_type for r in out} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_odd_inputs(spark, tmp_path):
    rows = [(None, None, None), (None, "u", "same"), (1, "u", "same"), (1, "u", "same"), (1, "u", "other"), (0, "u", "other"), (2, "u\r\nX: y", "é\r\n\r\nWARC/1.1")]
    _, _, out = archive(spark, tmp_path, rows, bundle="'b'", sha1="1", id="2", payload="'p'")
    assert len(out) == 7
    assert sorted((r.id, r.record_type, r.refers_to_id) for r in out if r.id is not None) == [(0, "response", None), (1, "response", None), (1, "response", None), (1, "revisit", "<urn:page:0>"), (2, "response", None)]
    (tmp_path / "none").mkdir()
    empty = W.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert W.read_archive(empty, f"file://{tmp_path}/none").count() == 0 and not list((tmp_path / "none").iterdir())
