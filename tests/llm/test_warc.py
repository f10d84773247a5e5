"""WARC derivatives: links, digests and round trips, text by construction, encodings, types, records that can't be read."""

import gzip
import hashlib
import html
import random
import time
import zlib

import pytest
import zstandard

from krathong.llm import warc_derive as W


def test_derivatives_link_and_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &amp; t</title><p>Hi&nbsp;<b>you</b></p><a href='/x'>l</a>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    src = W.responses(pages)
    resp = {r.record_id: r for r in src.collect()}
    rows = W.derive(src, "page_id").collect()
    assert len(rows) == 6 and {r.record_type for r in rows} == {"conversion", "metadata"}
    for r in rows:
        assert r.refers_to in resp and r.date == W.DATE and r.block_digest == W.sha1(bytes(r.block))
        body = bytes(resp[r.refers_to].block).split(b"\r\n\r\n", 1)[1]
        assert r.payload_digest == W.sha1(body)
    one = {r.record_type: r for r in rows if r.page_id == 1}
    assert bytes(one["conversion"].block).decode() == "Hi you\nl"
    meta = bytes(one["metadata"].block).decode()
    assert f"conversion-record: {one['conversion'].record_id}" in meta and "title: T & t" in meta and "outlink: /x" in meta
    key = lambda rs: sorted((r.record_id, r.refers_to, r.record_type, bytes(r.block)) for r in rs)
    raw = [W.serialize(r.asDict()) for r in rows]
    (tmp_path / "x.warc").write_bytes(b"".join(raw))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    assert key(W.read_warc(spark, str(tmp_path / "x.warc")).collect()) == key(rows) == key(W.read_warc(spark, str(tmp_path / "x.warc.gz")).collect())
    assert key(W._one(x.split(b"\r\n", 1)[1].split(b"\r\n\r\n", 1)[0], x.split(b"\r\n\r\n", 1)[1]) and r for x, r in zip(raw, rows)) == key(rows)
    assert W.derive(src.limit(0)).count() == 0
    both = W.derive(src, "record_id")
    assert both.columns.count("record_id") == 1 and {r.source_record_id for r in both.collect()} == set(resp)


def test_large_plain_files_are_split(spark, tmp_path):
    records = [{"record_type": "response", "record_id": f"<{i}>", "block": b"HTTP/1.1 200 OK\r\n\r\nx" * (i % 7 + 1) + b"\r\n\r\n"} for i in range(3000)]
    (tmp_path / "big.warc").write_bytes(b"".join(map(W.serialize, records)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = W.read_warc(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 3
        assert sorted((r.record_id, bytes(r.block)) for r in got.collect()) == sorted((r["record_id"], r["block"]) for r in records)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>one</p><svg class=i /><p>two</p><p>three</p>", "one\ntwo\nthree"),
        ("<p>one</p><svg/><p>two</p><SVG a=b><text>x</text></svg><p>three</p>", "one\ntwo\nthree"),
        ("<p>one</p><svg><p>two</p><template><noscript><title>three", "one\ntwo\nthree"),
        ("<title>t</title><!-- <p>c</p> --><p>one<noscript>n</noscript></p><script>var a='</p>';</script><style>s</style>two<!-- to the end", "one\ntwo"),
        ("one<script>var a", "one"),
        ("<p>a<![foo[x]]>b < c</p><a b='", "ab < c"),
        ("<p>one\ntwo</p>", "one two"),
        ("<p>x</p><svg>" * 20_000, "\n".join("x" * 20_000)),
    ],
)
def test_plain_text_of_odd_markup(page, want):
    assert W.plain_text(page) == want


def test_text_title_and_links_by_construction():
    """Pages made of known blocks: the text, the title and the links that went in come out."""
    rng = random.Random(4)
    words = ["one", "Ünï", "a&b", "<tag>", "x = 3", "été", '"q"', "5 > 4", "&amp;"]
    for _ in range(300):
        blocks, links, page = [], [], ""
        for _ in range(rng.randint(0, 8)):
            text = " ".join(rng.choices(words, k=rng.randint(1, 5)))
            inner = html.escape(text)
            kind = rng.choice(["p", "div", "h2", "li", "td", "script", "style", "svg", "comment", "link", "inline"])
            if kind in ("script", "style", "svg"):
                page += f"<{kind} a='<p>'>{'x<y' if kind != 'svg' else '<g>x</g>'}</{kind}>"
            elif kind == "comment":
                page += "<!-- <p>no</p> -->"
            else:
                if kind == "link":
                    links.append(f"/{len(links)}?a=1&b={rng.randint(0, 3)}")
                    inner = f'<a class=x href="{html.escape(links[-1])}">{inner}</a>'
                elif kind == "inline":
                    inner = "<b>" + inner.replace(" ", " </b><i title='a>b'> ", 1) + "</i>"
                tag = kind if kind in ("p", "div", "h2", "li", "td") else "p"
                page += f"<{tag.upper() if rng.random() < 0.2 else tag}>\n {inner} </{tag}>"
                blocks.append(" ".join(text.split()))
        got = W.read_page(f"<html><head><title> T &lt; {len(blocks)}</title></head><body>{page}</body></html>")
        assert got == ("\n".join(blocks), f"T < {len(blocks)}", list(dict.fromkeys(links)))


@pytest.mark.parametrize("page", ["<a " * 20_000, "<a href=" * 20_000, "<svg>" * 20_000 + "</svg>", "<title>" * 20_000, "<!--" * 20_000, "<a href='x'>" * 20_000, "<svg></svg>" * 20_000])
def test_linear_time(page):
    began = time.process_time()
    W.read_page(page)
    assert time.process_time() - began < 3


def response(head: str, body: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body


def conversion(block: bytes, **more):
    out = {r["record_type"]: r for r in W.derive_one("<r>", "u", "d", block, more.get("digest"), {})}
    return (out["conversion"]["block"].decode() if "conversion" in out else None), out["metadata"]["block"].decode()


PAGE = "<p>Hällo</p><p>you</p>"
CHUNKED = b"".join(b"%x;a=b\r\n%s\r\n" % (len(x), x) for x in (PAGE.encode()[:5], PAGE.encode()[5:])) + b"0\r\n\r\n"


@pytest.mark.parametrize(
    ("head", "body"),
    [
        ("Content-Type: text/html; charset=latin-1", PAGE.encode("latin-1")),
        ("Content-Type: text/html; charset=idna", PAGE.encode()),
        ("Content-Type: text/html; charset=undefined", PAGE.encode()),
        ("Content-Type: text/html; charset=hex", PAGE.encode()),
        ("Content-Type: text/html; charset=none-such", PAGE.encode()),
        ("Transfer-Encoding: chunked", CHUNKED),
        ("Content-Encoding: gzip", gzip.compress(PAGE.encode())),
        ("Content-Encoding: gzip", gzip.compress(PAGE.encode()[:9]) + gzip.compress(PAGE.encode()[9:])),
        ("Content-Encoding: deflate", zlib.compress(PAGE.encode())),
        ("Content-Encoding: deflate", zlib.compress(PAGE.encode())[2:-4]),
        ("Content-Encoding: zstd", zstandard.compress(PAGE.encode())),
        ("Content-Encoding: gzip", PAGE.encode()),
        ("Content-Encoding: br", PAGE.encode()),
        ("Transfer-Encoding: chunked", PAGE.encode()),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n%s\r\n0\r\n\r\n" % (len(gzip.compress(PAGE.encode())), gzip.compress(PAGE.encode()))),
    ],
)
def test_encodings(head, body):
    assert conversion(response(head, body))[0] == "Hällo\nyou"


def test_types():
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"
    for head in ("Content-Type: image/png", "Server: x"):
        text, meta = conversion(response(head, png))
        assert text is None and "conversion-record: none" in meta
    assert conversion(response("Content-Type: text/plain", b"a <b> c\r\n\r\nd"))[0] == "a <b> c\nd"
    assert conversion(response("Content-Type: application/xhtml+xml", b"<p>a</p>"))[0] == "a"
    assert conversion(b"")[0] == "" and conversion(b"no head at all")[0] == "no head at all"


def test_digests_are_verified():
    body = PAGE.encode()
    meta = lambda d: conversion(response("A: b", body), digest=d)[1]
    assert "digest-holds: yes" in meta(W.sha1(body)) and "digest-holds: yes" in meta("sha256:" + hashlib.sha256(body).hexdigest())
    assert "digest-holds: no" in meta(W.sha1(b"other")) and "digest-holds: unknown" in meta("crc:1") and "holds" not in meta(None)


GOOD = [W.serialize({"record_type": "response", "record_id": f"<{i}>", "block": b"HTTP/1.1 200 OK\r\n\r\n<p>%d</p>" % i}) for i in range(3)]
BAD = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nx\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n", b"junk\r\n"]


def test_bad_records_do_not_end_the_job(spark, tmp_path):
    found = lambda data: [r["record_id"] for r in W.parse(data) if r["record_type"] == "response"]
    want = ["<0>", "<1>", "<2>"]
    for bad in BAD:
        assert found(GOOD[0] + bad + GOOD[1] + bad + GOOD[2]) == want
    assert found(b"".join(GOOD) + GOOD[0][:-20]) == want
    packed = [gzip.compress(x) for x in GOOD]
    broken = gzip.compress(GOOD[0])
    for bad in (broken[:-12], broken[:20] + b"\xff\xff" + broken[22:], broken[:15]):
        assert found(packed[0] + bad + packed[1] + bad + packed[2] + bad) == want
    assert any(r["record_type"] == "invalid" for r in W.parse(packed[0] + broken[:-12]))
    (tmp_path / "x.warc").write_bytes(GOOD[0] + BAD[0] + GOOD[1] + BAD[1] + GOOD[2])
    rows = W.read_warc(spark, str(tmp_path / "x.warc"))
    assert sorted(r.record_id for r in rows.collect() if r.record_type == "response") == want
    assert rows.filter("record_type = 'invalid'").count() == 2 and W.derive(rows).count() == 6


def test_odd_rows(spark):
    schema = "record_id string, record_type string, target_uri string, date string, block binary, payload_digest string, headers map<string,string>, refers_to int, page_id string"
    long = b"HTTP/1.1 200 OK\r\n\r\n" + b"<p>word word</p>" * 60_000
    rows = [(None, "response", None, None, None, None, None, 1, "k")] * 2 + [("<a>", "response", "u", "d", long, None, {"A": "b"}, 1, None), ("<b>", "request", "u", "d", b"", None, None, 1, "k"), ("<c>", None, "u", "d", b"", None, None, 1, "k")]
    got = W.derive(spark.createDataFrame(rows, schema), "page_id").collect()
    assert len(got) == 6 and len({r.record_id for r in got}) == 4
    assert max(len(r.block) for r in got if r.record_type == "conversion") == 60_000 * 10 - 1


def test_a_block_that_holds_the_mark_comes_out_whole(spark, tmp_path):
    """Its length decides; a length that says too much spoils its own record only."""
    made = lambda k, block: {"record_type": "response", "record_id": f"<urn:uuid:{k}>", "block": block}
    inner = W.serialize(made(9, b"inner\r\n\r\nWARC/1.0 again"))
    data = b"".join(W.serialize(made(k, b)) for k, b in enumerate([b"one", b"two\r\n\r\nWARC/1.0\r\n" + inner, b"three"]))
    (tmp_path / "x.warc").write_bytes(data)
    key = lambda r: (r["record_type"], r["record_id"], bytes(r["block"]))
    got = [key(r.asDict()) for r in W.read_warc(spark, str(tmp_path / "x.warc")).collect()]
    assert sorted(got) == sorted(key(r) for r in W.parse(data)) and len(got) == 3
    lying = data.replace(b"Content-Length: 3\r\n", b"Content-Length: 99999\r\n", 1)
    (tmp_path / "y.warc").write_bytes(lying)
    got = [r.record_type for r in W.read_warc(spark, str(tmp_path / "y.warc")).collect()]
    assert sorted(got) == ["invalid", "response", "response"]
