"""Archives: an exact round trip, members that stand alone, index entries."""

import gzip
import hashlib
from pathlib import Path

from casewright.llm import warc_archives as wa

PAGES = [
    (1, "http://a.example/x y", None),
    (2, None, ""),
    (3, "http://a.example/1", "é" * 600),
    (9, "http://a.example/2", "é" * 600),
    (5, "http://a.example/3", "é" * 600),
    (6, "http://a.example/4", "short"),
    (7, "http://a.example/5", "short"),
    (8, "http://a.example/6", "\r\n\r\nWARC/1.1\r\n\r\n" + "z" * 3_000_000),
    (None, "http://a.example/7", "q" * 1000),
    (4, "http://a.example/8", "q" * 1000),
    (4, "http://a.example/8", "q" * 1000),
]
SCHEMA = "page_id bigint, url string, html string"


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    rows = wa.archived(spark, pages, f"file://{tmp_path}/warc").collect()
    assert len(rows) == len(PAGES)
    payload = {p: (h or "").encode() for p, _, h in PAGES}
    for r in rows:
        data = payload[r["page_id"]]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows}
    assert {(3, "revisit", 9), (5, "revisit", 9), (9, "response", None), (6, "response", None), (7, "response", None)} <= kinds
    assert (None, "revisit", 4) in kinds and (4, "response", None) in kinds


def test_members_and_index(spark, tmp_path):
    wa.archived(spark, spark.createDataFrame(PAGES, SCHEMA).coalesce(1), str(tmp_path / "warc")).collect()
    archive = next(Path(tmp_path, "warc", "members").glob("*.warc.gz"))
    data, entries = archive.read_bytes(), [x.split(" ") for x in Path(f"{archive}.idx").read_text().splitlines()]
    assert len(entries) == len(PAGES)
    for at, length, kind, identity in entries:
        head = gzip.decompress(data[int(at) : int(at) + int(length)]).split(b"\r\n\r\n", 1)[0].decode()
        assert head.startswith("WARC/1.1") and f"WARC-Type: {kind}" in head and identity in head
    # The whole archive reads as one stream too, and is that of the monolithic file.
    whole = next(Path(tmp_path, "warc", "whole").glob("*.warc.gz"))
    assert gzip.decompress(data) == gzip.decompress(whole.read_bytes())


def test_empty(spark, tmp_path):
    assert wa.archived(spark, spark.createDataFrame([], SCHEMA), str(tmp_path / "none")).count() == 0
