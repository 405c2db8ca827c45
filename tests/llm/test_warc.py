import hashlib

from bitloom.llm import warc

LONG = "é<p>long\r\n\r\ntext</p>" * 90
ROWS = [(1, "http://a/1", LONG), (5, "http://a/5", LONG), (3, None, LONG), (None, "http://a/n", LONG), (7, "http://a/\r\n7", "short"), (8, "u", "short"), (9, "u", None), (10, "u", ""), (11, "u", "x" * 1000), (11, "u", "x" * 1000), (12, "u", "y" * 999), (13, "u", "y" * 999), (14, "u", "z" * 300000)]


def brute():
    out = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        same = [k for k, _, x in ROWS if (x or "").encode() == b and k is not None]
        keeper = max(same) if len(b) >= 1000 and sum((x or "").encode() == b for _, _, x in ROWS) > 1 and same else None
        refers = keeper if keeper is not None and keeper != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers else "response", refers))
    return sorted(out, key=str)


def frame(spark):
    return spark.createDataFrame([(*r, "x", 0) for r in ROWS], "page_id long, url string, html string, digest string, archive int")


def test_round_trip(spark):
    assert sorted(map(tuple, warc.round_trip(frame(spark)).collect()), key=str) == brute()
    assert warc.round_trip(frame(spark).limit(0)).count() == 0


def test_selected_records_and_files(spark, tmp_path):
    index = warc.write(frame(spark), f"file://{tmp_path}/w", archive_bytes=2000)
    got = warc.read(warc.located(index.where("page_id in (5, 7, 14)"), f"file://{tmp_path}/w"), html=True).collect()
    assert {r.page_id: r.html for r in got} == {5: LONG, 7: "short", 14: "z" * 300000}
    files = list(tmp_path.glob("w/archive=*/part-*"))
    assert sum(f.stat().st_size for f in files) == index.agg({"length": "sum"}).first()[0]
    first = files[0].read_bytes()
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: ") and first.endswith(b"\r\n\r\n")


def test_ranges_merge():
    rows = [("a", 0, 10), ("a", 12, 8), ("a", 100, 5), ("b", 0, 3), ("b", 3, 50)]
    assert list(warc.ranges(rows, 5, 40)) == [("a", 0, 20, 0, 2), ("a", 100, 105, 2, 3), ("b", 0, 3, 3, 4), ("b", 3, 53, 4, 5)]
