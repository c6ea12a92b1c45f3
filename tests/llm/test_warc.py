"""Operator 7: damaged gzip files, odd page ids and header parameters; a very long page."""

import base64
import gzip
import hashlib

from tijolo.llm import warc


def members(*texts):
    return [gzip.compress(t) for t in texts]


def test_gzip_members_are_read_one_by_one():
    texts = [b"first " * 5000, b"second " * 5000, b"third " * 5000]
    a, b, c = members(*texts)
    assert warc.opened(a + b + c, bad := []) == b"".join(texts) and bad == []
    assert warc.opened(a + b"\0" * 512 + b, bad := []) == texts[0] + texts[1] and bad == []
    assert warc.opened(b"plain", bad := []) == b"plain" and bad == []
    assert warc.opened(b"", bad := []) == b"" and bad == []
    # cut: what came out stays
    got = warc.opened(a + b[: len(b) // 2], bad := [])
    assert got.startswith(texts[0]) and texts[1].startswith(got[len(texts[0]) :]) and bad == [(len(a), "gzip member cut short")]
    # flipped bytes: the next member is found again
    wrong = bytearray(b)
    wrong[len(b) // 2] ^= 0xFF
    got = warc.opened(a + bytes(wrong) + c, bad := [])
    assert got.startswith(texts[0]) and got.endswith(texts[2]) and bad == [(len(a), "wrong gzip member")]
    wrong = bytearray(b)
    wrong[-6] ^= 1  # only the checksum is wrong
    assert warc.opened(a + bytes(wrong) + c, bad := []) == b"".join(texts) and bad == [(len(a), "wrong gzip member")]
    # trailing junk, and junk that looks like a member
    assert warc.opened(a + b"junk" + b"\x1f\x8b\x08junk", bad := []) == texts[0] and [r for _, r in bad] == ["no gzip member"]
    assert warc.opened(a + b"junk" + c, bad := []) == texts[0] + texts[2] and bad == [(len(a), "no gzip member")]


def page(i):
    return b"".join(hashlib.sha256(b"%d %d" % (i, j)).hexdigest().encode() for j in range(50))


def stored(spark, folder, *contents):
    folder.mkdir()
    for i, c in enumerate(contents):
        (folder / f"part-{i}.gz").write_bytes(c)
    return str(folder)


def test_damage_of_archives_is_returned_and_the_rest_converted(spark, tmp_path):
    whole = warc.arc_head(1, "x.arc") + b"".join(warc.arc_record(1, "x.arc", 0, f"http://h/{i}", i, page(i)) for i in range(6))
    z = gzip.compress(whole)
    flipped = bytearray(z)
    flipped[-5] ^= 1
    # records compressed one by one, of which the third is wrong
    parts = [warc.arc_head(2, "y.arc"), *(warc.arc_record(2, "y.arc", 0, f"http://g/{i}", 10 + i, b"leaf %d " % i * 400) for i in range(4))]
    each = [bytearray(gzip.compress(p)) for p in parts]
    each[3][40] ^= 0xFF
    path = stored(spark, tmp_path / "a", z[: len(z) * 2 // 3], bytes(flipped), z + b"trailing", b"".join(map(bytes, each)), b"", b"\x1f\x8b")
    damage = warc.convert(spark, path, str(tmp_path / "w")).collect()
    assert {(r.path[-9:], r.reason) for r in damage if "gzip" in r.reason} == {("part-0.gz", "gzip member cut short"), ("part-1.gz", "wrong gzip member"), ("part-2.gz", "no gzip member"), ("part-3.gz", "wrong gzip member"), ("part-5.gz", "no gzip member")}
    ids = [int(r.page_id) for r in warc.read(spark, str(tmp_path / "w")).collect()]
    assert {i: ids.count(i) for i in (0, 5, 10, 11, 12, 13)} == {0: 3, 5: 2, 10: 1, 11: 1, 12: 0, 13: 1}


def test_ids_that_are_no_numbers_and_types_with_parameters(spark, tmp_path):
    text = warc.arc_head(1, "x.arc") + b"".join(warc.arc_record(1, "x.arc", 0, "http://h/", i, b"same") for i in ("abc", 7, None, 3, "9x"))
    text = text.replace(b" text/html ", b" text/html; charset=utf-8; q=1 ", 2).replace(b" text/html ", b" text/html;charset=utf-8 ", 1)
    path = stored(spark, tmp_path / "a", gzip.compress(text))
    assert warc.convert(spark, path, str(tmp_path / "w")).count() == 0
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.read(spark, str(tmp_path / "w")).collect())
    assert got == [("3", "response", "None"), ("7", "revisit", "3"), ("9x", "response", "None"), ("None", "response", "None"), ("abc", "response", "None")]


def test_a_very_long_page(spark, tmp_path):
    html = "<p>é long</p>" * 800_000
    pages = spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", "short")], "page_id long, url string, html string")
    warc.write_arc(pages, str(tmp_path / "a"))
    assert warc.convert(spark, str(tmp_path / "a"), str(tmp_path / "w")).count() == 0
    got = {int(r.page_id): r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got[1].payload_digest == got[2].payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode() and got[2].refers_to == "1"
