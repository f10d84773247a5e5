"""WARC derivatives: linked metadata and plain-text conversion records from response records.

Both derived records name the response in WARC-Refers-To and carry its target, date and payload
digest. The metadata block lists the response's HTTP status and headers, its digests and whether they hold, the title
and the links, and names the conversion record. Transfer and content encodings are undone first. A payload
that is no text (by its type, or by its bytes where no type is given) has a metadata record only. Record
ids are hashes of what they name, so a rerun after a lost executor gives the same ids.

A record that can't be read (no length, cut off, a broken gzip member) becomes one of type ``invalid`` that names
the fault, and reading goes on with the next; it never ends the job.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import re
import uuid
import zlib
from collections import deque
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .html_extract import tokens

RECORD = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, headers map<string,string>, block binary"
#: Date of responses made from a table that has none.
DATE = "2024-01-01T00:00:00Z"
#: Elements at which a line of text ends, and those whose content is not part of the text.
BREAKS = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("noscript template svg title".split())
#: Types whose payload is text.
TEXTUAL = re.compile(r"^\s*(?:text/|application/(?:xhtml\+xml|xml|json|javascript)\b|[\w.-]+/[\w.-]+\+(?:xml|json)\b)", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, payload) of a response block; a block without a head is all payload."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not gap:
        return "", [], block
    first, *rest = head.decode("latin-1").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in " \t" and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            fields.append((k.strip(), v.strip()))
    return first, fields, body


def field(fields: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in fields if k.lower() == name), "")


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; one that is not chunked, or is cut, is taken as far as it goes."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return b"".join([*out, body[at:]]) if not out else b"".join(out)
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def inflated(body: bytes, wbits: int) -> bytes:
    """All members of a zlib or gzip body, the last as far as it goes."""
    out = []
    while body:
        d = zlib.decompressobj(wbits)
        try:
            out.append(d.decompress(body))
        except zlib.error:
            break
        if not d.eof or d.unused_data == body:
            break
        body = d.unused_data
    return b"".join(out)


def entity(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """The body with its transfer and content encodings undone; one that is unknown or does not fit leaves it as it is."""
    if "chunked" in field(fields, "transfer-encoding").lower():
        body = unchunked(body)
    for name in reversed([x.strip().lower() for x in field(fields, "content-encoding").split(",")]):
        plain = b""
        if name in ("gzip", "x-gzip"):
            plain = inflated(body, 31)
        elif name == "deflate":
            plain = inflated(body, 15) or inflated(body, -15)
        elif name == "zstd":
            try:
                plain = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            except zstandard.ZstdError:
                plain = b""
        body = plain or body
    return body


def is_text(payload: bytes, kind: str) -> bool:
    """By the type; where none is given, a payload without null bytes in its first part is text."""
    return bool(TEXTUAL.match(kind)) if kind.strip() else b"\0" not in payload[:4096]


def decode(payload: bytes, content_type: str) -> str:
    """By the declared character set, else as UTF-8; a set that is unknown or no text encoding counts as undeclared."""
    found = _CHARSET.search(content_type) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def read_page(page: str) -> tuple[str, str, list[str]]:
    """(text, title, links) of a page in one pass.

    The text has one line for each block, white space collapsed, character references decoded. Scripts, styles and
    comments are passed over; without an end they reach to the end of the page, as in browsers. Of a noscript, template,
    svg or title without an end, and of a self-closed svg, only the tag goes.
    """
    parts: list[tuple[str, str]] = []  # tag name (with / for an end) or "", piece
    ends: dict[str, list[int]] = {x: [] for x in HIDDEN}
    for tag, piece in tokens(page):
        m = _TAG.match(piece) if tag else None
        name = m[1] + m[2].lower() if m else ""
        if name[1:] in ends and name[0] == "/":
            ends[name[1:]].append(len(parts))
        parts.append((name, piece))
    for x in ends.values():
        x.reverse()
    out, links, title, at = [], [], "", 0
    while at < len(parts):
        name, piece = parts[at]
        if name in HIDDEN and not piece.endswith("/>"):
            while ends[name] and ends[name][-1] < at:
                ends[name].pop()
            if ends[name]:
                if name == "title":
                    title = title or " ".join(html_lib.unescape("".join(p for n, p in parts[at + 1 : ends[name][-1]] if not n)).split())
                out.append(" ")
                at = ends[name][-1] + 1
                continue
        if not name:
            out.append(piece)
        elif name.lstrip("/") in BREAKS:
            out.append("\n")
        elif name == "a":
            m = _HREF.search(piece)
            link = html_lib.unescape(next(g for g in m.groups() if g is not None)).strip() if m else ""
            if link:
                links.append(" ".join(link.split()))
        at += 1
    # line feeds of the markup are white space like any other: only blocks end lines
    lines = html_lib.unescape("".join(x if x == "\n" else x.replace("\n", " ").replace("\r", " ") for x in out)).split("\n")
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x), title, list(dict.fromkeys(links))


def plain_text(page: str) -> str:
    return read_page(page)[0]


_ALGORITHMS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "md5": hashlib.md5, "sha512": hashlib.sha512}


def holds(digest: str, *payloads: bytes) -> str:
    """yes or no: whether a labelled digest, in base 32 or hexadecimal, is that of one of the payloads; unknown for an algorithm that is."""
    name, _, value = digest.partition(":")
    algorithm = _ALGORITHMS.get(name.strip().lower())
    if algorithm is None:
        return "unknown"
    value = value.strip()
    found = [algorithm(x).digest() for x in payloads]
    return "yes" if any(value.upper().rstrip("=") == base64.b32encode(d).decode().rstrip("=") or value.lower() == d.hex() for d in found) else "no"


def derive_one(rid: str, uri: str, date: str, block: bytes, payload_digest: str | None, headers: dict) -> list[dict]:
    """The conversion, if the payload is text, and the metadata record of one response."""
    status, fields, body = split_http(block)
    kind = field(fields, "content-type")
    payload = entity(fields, body)
    digest = payload_digest or sha1(body)
    textual = is_text(payload, kind)
    page = decode(payload, kind) if textual else ""
    markup = textual and not re.match(r"\s*(?:text/plain|application/(?:json|javascript))", kind, re.I)
    text, title, links = read_page(page) if markup else ("\n".join(x for x in (" ".join(line.split()) for line in page.split("\n")) if x), "", [])
    text = text.encode("utf-8", "replace")
    cid = record_id("conversion", rid, digest)
    lines = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in fields), *((f"source-{k.lower()}", v) for k, v in sorted(headers.items())), ("source-payload-digest", digest)]
    lines += [("source-payload-digest-holds", holds(payload_digest, body, payload) if payload_digest else ""), ("source-block-digest", sha1(block)), ("conversion-record", cid if textual else "none"), ("title", title)]
    lines += [("outlink", x) for x in links]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines if v).encode("utf-8", "replace")
    same = {"refers_to": rid, "target_uri": uri, "date": date, "payload_digest": digest, "headers": headers}
    conversion = {"record_id": cid, "record_type": "conversion", "content_type": "text/plain; charset=utf-8", "block_digest": sha1(text), "block": text} | same
    metadata = {"record_id": record_id("metadata", rid, digest), "record_type": "metadata", "content_type": "application/warc-fields", "block_digest": sha1(meta), "block": meta} | same
    return [conversion, metadata] if textual else [metadata]


def derive(responses: DataFrame, key_col: str | None = None) -> DataFrame:
    """A metadata record and, where the payload is text, a conversion record for each row of ``responses`` (RECORD columns; record_type response).

    Rows of other record types are passed over. A null block counts as empty; a null record id is replaced by a
    hash of target, date and block; null targets and dates are the empty string; absent digests are computed, given ones
    kept and verified. Repeated rows give repeated records with equal ids. ``key_col``: a column to carry along, named
    ``source_...`` if a record has a column of that name. Other columns are not read. An empty table gives none.
    """
    rows = responses.filter("record_type = 'response'").select(*([F.col(f"`{key_col}`").alias("_key")] if key_col else [F.lit(0).alias("_key")]), "record_id", "target_uri", "date", "block", "payload_digest", "headers")
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, {RECORD}"
    names = [x.split()[0] for x in schema.split(", ")]
    carried = f"source_{key_col}" if key_col in names else key_col

    def run(batches):
        for b in batches:
            kind = b.schema.field(0).type
            out = []
            size = 0
            for r in b.to_pylist():
                block, uri, date = r["block"] or b"", r["target_uri"] or "", r["date"] or ""
                rid = r["record_id"] or record_id("response", uri, date, sha1(block))
                for x in derive_one(rid, uri, date, block, r["payload_digest"], dict(r["headers"] or {})):
                    out.append(x | {"_key": r["_key"], "headers": list(x["headers"].items())})
                    size += len(x["block"])
                if size > 1 << 23:
                    yield batch(out, names, kind)
                    out, size = [], 0
            if out:
                yield batch(out, names, kind)

    got = rows.mapInArrow(run, schema)
    return got.withColumnRenamed("_key", carried) if key_col else got.drop("_key")


def batch(rows: list[dict], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    kind = {"_key": key, "headers": pa.map_(pa.string(), pa.string()), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind.get(n, pa.string())) for n in names], names)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages, in SQL functions; ``id_col`` is carried along."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    url = F.coalesce(F.col(url_col), F.lit(""))
    hexed = F.sha1(F.concat_ws("\x00", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url, F.sha1(body)))
    uid = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.concat(F.substring(hexed, 1, 12), F.lit("5"), F.substring(hexed, 14, 3), F.lit("a"), F.substring(hexed, 18, 15)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    return pages.select(
        F.col(id_col),
        uid.alias("record_id"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast("string").alias("refers_to"),
        url.alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.lit(None).cast("string").alias("block_digest"),
        F.create_map(F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Date"), F.lit(DATE)).alias("headers"),
        F.concat(head, body).cast("binary").alias("block"),
    )


def serialize(r: dict) -> bytes:
    """One record in WARC/1.1 form."""
    fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r.get("refers_to")), ("WARC-Target-URI", r.get("target_uri")), ("WARC-Date", r.get("date")), ("WARC-Payload-Digest", r.get("payload_digest")), ("WARC-Block-Digest", r.get("block_digest")), ("Content-Type", r.get("content_type")), ("Content-Length", str(len(r["block"] or b"")))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v).encode("utf-8", "surrogatepass") + b"\r\n" + (r["block"] or b"") + b"\r\n\r\n"


_FIELDS = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "date", "warc-payload-digest": "payload_digest", "warc-block-digest": "block_digest", "content-type": "content_type"}


_BEGIN = re.compile(rb"WARC/[0-9]")


def _invalid(why: str, block: bytes = b"") -> dict:
    return dict.fromkeys([x.split()[0] for x in RECORD.split(", ")]) | {"record_type": "invalid", "headers": {"error": why}, "block": block}


def _one(head: bytes, block: bytes) -> dict:
    """A record of its head (the lines after the version) and its block, which is cut to its length."""
    r = _invalid("") | {"record_type": None, "headers": {}}
    size = None
    for line in head.split(b"\n"):
        k, _, v = line.decode("utf-8", "replace").partition(":")
        k, v = k.strip(), v.strip()
        if not k or not v:
            continue
        r["headers"][k] = v
        if k.lower() in _FIELDS:
            r[_FIELDS[k.lower()]] = v
        elif k.lower() == "content-length" and re.fullmatch(r"[0-9]{1,15}", v):
            size = int(v)
    if size is None:
        return _invalid("no length", block)
    if size > len(block):
        return _invalid(f"cut off: {len(block)} of {size} bytes", block)
    return r | {"block": block[:size]}


def parse_plain(data: bytes):
    """The records of uncompressed WARC data; after one that can't be read, the next line that begins a record is sought."""
    at = 0
    while m := _BEGIN.search(data, at):
        first = data.find(b"\n", m.start())
        gap = re.compile(rb"\r?\n\r?\n").search(data, first) if first >= 0 else None
        if gap is None:
            yield _invalid("no end of the head", data[m.start() :])
            return
        head = data[first + 1 : gap.start()]
        size = re.search(rb"^content-length\s*:\s*([0-9]{1,15})\s*$", head, re.I | re.M)
        end = gap.end() + int(size[1]) if size else gap.end()
        yield _one(head, data[gap.end() : end])
        at = end if size and end <= len(data) else gap.end()
        later = data.find(b"WARC/", at)
        if later < 0:
            return
        at = later


def members(data: bytes):
    """(bytes, whole) of each gzip member; after one that is broken, the next one's first bytes are sought."""
    at = 0
    while 0 <= at < len(data):
        d, out, whole = zlib.decompressobj(31), [], False
        pos = at
        try:
            while pos < len(data) and not d.eof:
                step = data[pos : pos + (1 << 20)]
                out.append(d.decompress(step))
                pos += len(step)
            whole = d.eof
        except zlib.error:
            pass
        yield b"".join(out), whole
        at = pos - len(d.unused_data) if whole else data.find(b"\x1f\x8b\x08", at + 1)


def parse(data: bytes):
    """The records of a WARC file, plain or gzipped member by member, one at a time."""
    if data[:2] != b"\x1f\x8b":
        yield from parse_plain(data)
        return
    held = b""  # a record may go over members, and a member may hold many
    for part, whole in members(data):
        if not whole:
            yield from parse_plain(held) if held else ()
            yield _invalid("broken gzip member", part)
            held = b""
        elif held and part.startswith(b"WARC/"):
            yield from parse_plain(held)
            held = part
        else:
            held += part
    if held:
        yield from parse_plain(held)


def _batches(rows, names):
    out, size = [], 0
    for r in rows:
        out.append(r | {"headers": list(r["headers"].items())})
        size += len(r["block"])
        if size > 1 << 23:
            yield batch(out, names, pa.null())
            out, size = [], 0
    if out:
        yield batch(out, names, pa.null())


#: What parts records, and the longest block that is put together again.
MARK, LONGEST = b"\r\n\r\nWARC/", 1 << 30


def _joined(pieces):
    """The records of the pieces of a split in order: the length of a block decides, so pieces that a mark inside of it has cut are joined again.

    Where a length says more than the split has left, the record is cut off and what follows it are records of their own.
    """
    again = deque()
    take = lambda: again.popleft() if again else next(pieces, None)
    while (x := take()) is not None:
        if not x.strip():
            continue
        m = re.match(rb"(?:WARC/)?[0-9][^\n]*\n(.*?\n)?\r?\n(.*)", x, re.S)
        if not m:
            yield _invalid("no head")
            continue
        head, parts, more = m[1] or b"", [m[2]], []
        size = re.search(rb"^content-length\s*:\s*([0-9]{1,15})\s*$", head, re.I | re.M)
        size, have = int(size[1]) if size else 0, len(m[2])
        while have < size <= LONGEST and (y := take()) is not None:
            more.append(y)
            parts += [MARK, y]
            have += len(MARK) + len(y)
        if more and have < size:
            again.extendleft(reversed(more))
            parts = parts[:1]
        yield _one(head, b"".join(parts))


def read_warc(spark: SparkSession, path: str, compressed: bool | None = None) -> DataFrame:
    """Records of the WARC files under a path that Spark can read; those that can't be read are of type ``invalid``.

    Uncompressed files are cut at ``\\r\\n\\r\\nWARC/`` by Spark's splittable text reader, so that many tasks share a file of any
    size; a block that itself holds these bytes is put together again by its length, unless a split ends within it: then it comes out as cut off. A gzipped file is one task's work and
    below 2 GB, as its members can't be told apart from the middle. ``compressed`` is guessed from the path (``.gz``).
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    if path.rstrip("/*").endswith(".gz") if compressed is None else compressed:

        def files(batches):
            for b in batches:
                for data in b.column(0):
                    yield from _batches(parse(data.as_py()), names)

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(files, RECORD)

    def pieces(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, run in groupby(rows, key=lambda r: r[1:]):
            yield from _batches(_joined(r[0] for r in run), names)

    cut = spark.read.option("lineSep", MARK.decode()).text(path)
    return cut.select(F.col("value").cast("binary").alias("content"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at")).mapInArrow(pieces, RECORD)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = derive(responses(C.table(spark, sf_dir, "pages")), "page_id")
    return got.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", F.col("block").cast("string").alias("block"), F.octet_length("block").cast("long").alias("n_bytes"))
