"""Operator 7: pages into ARC archives, and legacy ARC archives into WARC.

An ARC file is a sequence of records, each a header line and as many bytes as the line declares. The
file's first record names the version: lines of version 1 have five fields, those of version 2 ten.
The converter synthesises what WARC has and ARC has not: record identifiers (from address, date and
payload digest), ISO timestamps, record types and SHA-1 digests. Archives are files written by Spark's
text writer, one row a file, gzip-compressed; they are read back as binary files. Damaged ARC records and
gzip members are left out and reported, and reading goes on behind them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tijolo.llm.common import fresh_path, partitions, small_batches, table, written

#: An archive is closed once it holds so many bytes. One page is never split.
ARCHIVE_BYTES = 4 << 20
#: Payloads under so many bytes are never revisits.
LEAST_BYTES = 0
#: Bytes of stored ARC archives that one task of the converter gets, about.
TASK_BYTES = 64 << 20
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
DATE, IP, KIND = "20240101000000", "0.0.0.0", "text/html"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "tijolo:arc")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _address(url: str | None) -> str:
    """An address without blanks or controls, as header fields are divided by blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


# --- ARC


def arc_head(version: int, name: str) -> bytes:
    block = f"{version} 0 tijolo\n{FIELDS[version]}\n".encode()
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} {IP} {DATE} text/plain {middle}{len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, name: str, offset: int, url: str | None, page_id: object, payload: bytes) -> bytes:
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    middle = "" if version == 1 else f"200 {hashlib.md5(payload).hexdigest()} - {offset} {name} "
    return f"{_address(url)} {IP} {DATE} {KIND} {middle}{len(block)}\n".encode() + block + b"\n"


#: A header line: address, IP, 14 digits of a date, type, which may have parameters, and at last the length; those of version 2
#: have five fields more in between.
_HEADER = re.compile(rb"^(\S+) (\S+) (\d{14}) ([^\s;]+(?:; *[^\s;]+)*;?) ((?:\S+ ){5})?(\d+)\r?$", re.M)


def read_arc(raw: bytes, damaged: list[tuple[int, str]] | None = None) -> Iterator[dict]:
    """Records after the version block: url, ip, date, kind and block, by the header's declared length.

    What is no header line of the file's version, a block that is cut short, and a file without a known version are damage:
    its place and reason are added to `damaged`, and reading goes on at the next header line behind it, if there is one.
    """
    at, version = 0, 0
    note = lambda reason: damaged.append((at, reason)) if damaged is not None else None
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        header = _HEADER.match(raw, at)
        if not header or version and bool(header[5]) != (version == 2):
            note("no header line")
            following = _HEADER.search(raw, at + 1)
            if not following:
                return
            at = following.start()
            continue
        length = int(header[6])
        block = raw[header.end() + 1 : header.end() + 1 + length]
        if len(block) < length:
            note("cut short")
            following = _HEADER.search(raw, header.end())
            if not following:
                return
            at = following.start()
            continue
        if not version:
            first = block.split(b" ", 1)[0]
            version = int(first) if first in (b"1", b"2") else 0
            if not version:
                note("unknown version")
                return
        else:
            url, ip, date, kind = (x.decode("utf-8", "replace") for x in header.groups()[:4])
            yield {"url": url, "ip": ip, "date": date, "kind": kind, "block": block}
        at = header.end() + 1 + length


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers, names in lower case, and the payload behind them."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, payload


# --- WARC


def record_id(url: str, date: str, page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {date} {page_id} {digest}')}>"


def warc_record(arc: dict, revisits: dict[str, tuple[str, str]]) -> bytes:
    """The WARC record of an ARC record; revisits: page_id to the page_id and identifier it repeats."""
    http, payload = payload_of(arc["block"])
    page_id, digest, d = http.get("x-page-id"), sha1(payload), arc["date"]
    first = revisits.get(page_id)
    block = arc["block"][: len(arc["block"]) - len(payload)] if first else arc["block"]
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {record_id(arc['url'], d, page_id, digest)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-Target-URI: {arc['url']}", f"WARC-IP-Address: {arc['ip']}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}",
    ]
    if first:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {first[1]}", f"X-Refers-To-Page: {first[0]}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by Content-Length."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one is due")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(head["content-length"])
        block = raw[end + 4 : end + 4 + length]
        if len(block) < length or raw[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        at = end + 8 + length
        yield head, block


# --- Spark


def _save(archives: DataFrame, path: str) -> None:
    """One gzip-compressed file a row of (content binary), whose bytes get one more line feed at the end."""
    archives.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _load(spark: SparkSession, path: str) -> DataFrame:
    small_batches(spark)  # a few archives at a time
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _opened(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == _GZIP[:2] else content


_GZIP, _STEP = b"\x1f\x8b\x08", 1 << 16


def opened(content: bytes, damaged: list[tuple[int, str]] | None = None) -> bytes:
    """What is in an archive that may be gzip-compressed, in one member or many, and damaged.

    A member that is cut short or wrong gives what comes out of it before, and reading goes on at the next member behind its
    beginning that gives anything; zeros between members are padding. Places in the compressed bytes and reasons are added to `damaged`.
    """
    if content[:2] != _GZIP[:2]:
        return content
    out, at = [], 0
    note = lambda reason: damaged.append((at, reason)) if damaged is not None else None
    while at < len(content):
        if content[at : at + 3] == _GZIP:
            member, d, i = [], zlib.decompressobj(31), at
            try:
                while i < len(content) and not d.eof:
                    member.append(d.decompress(content[i : i + _STEP]))
                    i += _STEP
            except zlib.error:
                member += _before_error(content[at : i + _STEP], sum(map(len, member)))
                note("wrong gzip member")
            else:
                if d.eof:
                    out += member
                    at = min(i, len(content)) - len(d.unused_data)
                    continue
                note("gzip member cut short")
            out += member
        following = content.find(_GZIP, at + 1)
        while following >= 0 and not _begins(content[following : following + _STEP]):
            following = content.find(_GZIP, following + 1)
        if content[at : at + 3] != _GZIP and content[at : following if following >= 0 else None].strip(b"\0"):
            note("no gzip member")
        if following < 0:
            break
        at = following
    return b"".join(out)


def _before_error(content: bytes, known: int) -> list[bytes]:
    """What a wrong member gives behind its first `known` bytes, up to the error."""
    d, got = zlib.decompressobj(31), []
    for size in (64, 1):  # what the failing call would have given is lost, so that the last bytes are fed one by one
        i = 0
        try:
            while i < len(content):
                before = d.copy()
                got.append(d.decompress(content[i : i + size]))
                i += size
        except zlib.error:
            d, content = before, content[i:]
    return [b"".join(got)[known:]]


def _begins(content: bytes) -> bool:
    """Whether these bytes begin a member that gives anything; the three bytes that begin one may stand anywhere."""
    try:
        return bool(zlib.decompressobj(31).decompress(content, 1))
    except zlib.error:
        return False


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC archives of the pages, by turns of version 1 and 2. Null html is an empty payload, a null address about:blank."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        version, parts, size, name = 1, [], 0, ""

        def close() -> pd.DataFrame:
            return pd.DataFrame({"content": [b"".join(parts)[:-1]]})

        for pdf in batches:
            for i, u, t in zip(pdf["i"].astype(object), pdf["u"], pdf["t"]):
                payload = (t or "").encode("utf-8", "surrogatepass")
                if not parts:
                    name = f"{zlib.crc32(payload):08x}-{i}.arc"
                    parts, size = [arc_head(version, name)], len(arc_head(version, name))
                parts.append(arc_record(version, name, size, u, None if pd.isna(i) else i, payload))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield close()
                    version, parts = 3 - version, []
        if parts:
            yield close()

    ids = F.col(page_id).cast("string")
    small_batches(pages.sparkSession)
    _save(pages.select(ids.alias("i"), F.col(url).alias("u"), F.col(html).alias("t")).mapInPandas(pack, "content binary"), path)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_BYTES, id_type: str = "bigint") -> DataFrame:
    """WARC archives of the ARC archives under arc_path, one for one; an archive without records gives none.
    Returns the damage: path, offset and reason of each place that was left out; offsets of gzip damage are those of the stored bytes.

    Of records with equal payloads of at least `least` bytes, the one with the smallest page id (read as
    id_type) is a response and the others revisit it; records without an id or with one that is not of id_type, and rows
    repeated with the id of the response, are responses. Only (digest, length, id) is grouped, so that a payload that many pages share
    is counted on the map side.
    """
    arcs = _load(spark, arc_path)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                damaged: list[tuple[int, str]] = []
                for r in read_arc(opened(content, damaged), damaged):
                    http, payload = payload_of(r["block"])
                    if len(payload) >= least and "x-page-id" in http:
                        digest = sha1(payload)
                        rows.append((path, http["x-page-id"], digest, len(payload), record_id(r["url"], r["date"], http["x-page-id"], digest)))
                rows.extend((path, None, reason, offset, None) for offset, reason in damaged)
            yield pd.DataFrame(rows, columns=["path", "page", "digest", "length", "record"])

    # as many tasks as keep archive bytes in one of them bounded, however many archives there are
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(arc_path).agg(F.sum("length")).first()[0] or 0
    tasks = max(partitions(spark), -(-stored // TASK_BYTES))
    every = written(arcs.mapInPandas(index, "path string, page string, digest string, length bigint, record string"), "arc-index")
    number = F.col("page").try_cast(id_type)
    found = every.where(F.col("record").isNotNull() & number.isNotNull())
    firsts = found.groupBy("digest", "length").agg(F.min(F.struct(number.alias("n"), F.col("page"), F.col("record"))).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    again = found.join(firsts, ["digest", "length"]).where(number > F.col("first.n"))
    again = again.groupBy("path").agg(F.collect_list(F.struct("page", F.col("first.page").alias("of"), F.col("first.record").alias("record"))).alias("again"))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, rows in zip(pdf["content"], pdf["again"]):
                revisits = {r["page"]: (r["of"], r["record"]) for r in (rows if rows is not None else [])}
                records = b"".join(warc_record(r, revisits) for r in read_arc(opened(content)))
                if records:  # an empty partition leaves an empty ARC file
                    yield pd.DataFrame({"content": [records[:-1]]})

    # an archive's list is no longer than the archive
    _save(arcs.repartition(tasks, "path").join(again.repartition(tasks, "path"), "path", "left").select("content", "again").mapInPandas(rewrite, "content binary"), warc_path)
    return every.where(F.col("record").isNull()).select("path", F.col("length").alias("offset"), F.col("digest").alias("reason"))


def read(spark: SparkSession, warc_path: str) -> DataFrame:
    """One row a record: page_id (text), record_type, record_id, url, payload_bytes and payload_digest of the full
    payload, refers_to (text) and payload, null for revisits. Responses' digests are checked against their bytes."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for head, block in read_warc(_opened(content)):
                    http, payload = payload_of(block)
                    digest, revisit = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "revisit"
                    if not revisit and sha1(payload) != digest:
                        raise ValueError(f"the payload of {head['warc-record-id']} has another digest")
                    rows.append((http.get("x-page-id"), head["warc-type"], head["warc-record-id"], head["warc-target-uri"], int(http["content-length"]) if revisit else len(payload), digest, head.get("x-refers-to-page"), None if revisit else payload))
                yield pd.DataFrame(rows, columns=["page_id", "record_type", "record_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return _load(spark, warc_path).mapInPandas(parse, "page_id string, record_type string, record_id string, url string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    write_arc(pages, arc)
    if not convert(spark, arc, warc, id_type=kind).isEmpty():
        raise ValueError(f"archives just written to {arc} are damaged")
    return read(spark, warc).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT x, min(page_id) AS least FROM p GROUP BY x)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM p JOIN g USING (x)
"""
