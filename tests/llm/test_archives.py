"""ARC to WARC: round trips, both header versions, revisits, awkward rows and broken files."""

from __future__ import annotations

import gzip
import hashlib
from collections import defaultdict

import pytest

from harvestlens.llm import archives

PAGES = "page_id long, url string, html string, archive string, record string, version int, key long"


def plain(rows):
    """What every page must come back as, by comparing all payloads."""
    least = defaultdict(list)
    payloads = [(k, (html or "").encode()) for k, html in rows]
    for k, body in payloads:
        least[body].append(k)
    out = []
    for k, body in payloads:
        first = min(least[body])
        again = len(body) >= 100 and k != first
        out.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out)


def trip(spark, rows, tmp_path, **changes):
    pages = spark.createDataFrame([(k, u, h, "a", "r", 7, 8) for k, u, h in rows], PAGES).repartition(3)
    return archives.round_trip(pages, f"{tmp_path}/arc", f"{tmp_path}/warc", **changes)


def test_round_trip_equals_plain(spark, tmp_path):
    long = "<p>é ß \U0001f600</p>\r\n\r\nWARC/1.1\r\n" * 9
    rows = [(k, f"https://e.org/{k}", h) for k, h in enumerate(
        [long, long, long + " ", "", None, "short", "short", "x" * 100, "x" * 100, "x" * 99, "x" * 99, "y" * 300_000, "\n\n", "HTTP/1.1 9\r\n\r\nz" * 20]
    )]
    got = trip(spark, rows, tmp_path, payloads=True).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain([(k, h) for k, _, h in rows])
    assert {r.problem for r in got} == {None}
    bodies = {k: (h or "").encode() for k, _, h in rows}
    assert all(bytes(r.payload) == bodies[r.page_id] for r in got if r.record_type == "response")
    by_id = {r.record_id: r.page_id for r in got}
    assert len(by_id) == len(rows)
    assert all(by_id[r.refers_to_id] == r.refers_to for r in got if r.record_type == "revisit")


def test_awkward_rows(spark, tmp_path):
    body = "same " * 40
    rows = [(None, None, body), (5, "has blank\nand break", body), (5, "", body), (9, "ü", None)]
    got = sorted(trip(spark, rows, tmp_path).collect(), key=lambda r: (r.page_id is None, r.page_id, r.record_type))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (5, "response", None), (5, "revisit", 5), (9, "response", None), (None, "revisit", 5)
    ]
    assert {r.url for r in got} == {"-", "ü", "has%20blank%0Aand%20break"}
    assert trip(spark, [], f"{tmp_path}/none").collect() == []


def test_small_archives_are_cut(spark, tmp_path):
    rows = [(k, "u", f"{k} " * 200) for k in range(60)]
    pages = spark.createDataFrame([(k, u, h) for k, u, h in rows], "page_id long, url string, html string").repartition(2)
    archives.write_archives(archives.arc_records(pages), f"{tmp_path}/arc", archives.arc_start, archives.ARC_END, archive_bytes=5000)
    files = archives.archive_files(spark, f"{tmp_path}/arc").collect()
    assert len(files) > 4 and max(len(gzip.decompress(f.content)) for f in files) < 7000
    assert archives.read_arc(spark, f"{tmp_path}/arc").count() == 60


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_by_version(version):
    start = archives.arc_start(version, "file.arc")
    body = b"HTTP/1.0 200 OK\nX\r\n\r\nbody\n\nwith 1 0 lines"
    more = b"404 sum - 77 file.arc " if version == 2 else b""
    line = b"http://e.org/a b 10.0.0.1 19961104142103 text/html " + more + b"%d\n" % len(body)
    content = start + b"\n" + line + body + b"\n" + line + body + b"\n"
    rows = list(archives.arc_entries("a", content))
    assert [r[2:] for r in rows] == [("http://e.org/a b", "10.0.0.1", "19961104142103", "text/html", body, None)] * 2
    assert archives.warc_date(rows[0][4]) == "1996-11-04T14:21:03Z"
    cut = list(archives.arc_entries("a", content[:-10]))
    assert [r[-1] for r in cut] == [None, "shorter than declared"]
    assert [r[-1] for r in archives.arc_entries("a", content.replace(b"%d\n" % len(body), b"long\n"))] == ["unreadable header line"]
    assert [r[-1] for r in archives.arc_entries("a", b"GIF89a")] == ["no version block"]
    assert list(archives.arc_entries("a", b"")) == []


def test_damage_is_told():
    good = archives.warc_record({"WARC-Type": "response", "WARC-Block-Digest": f"sha256:{hashlib.sha256(b'abc').hexdigest()}",
                                 "WARC-Payload-Digest": f"sha256:{hashlib.sha256(b'abc').hexdigest()}"}, b"abc") + b"\r\n\r\n"
    problems = lambda content: [r[-1] for r in archives.warc_entries("w", content)]
    assert problems(good + good) == [None, None]
    assert problems(good.replace(b"abc\r\n", b"abd\r\n")) == ["digest does not match"]
    assert problems(good[:-6]) == ["shorter than declared"]
    assert problems(b"junk") == ["unreadable header"]
