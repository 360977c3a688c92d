"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from.

Records are rows: warc_type, record_id, headers (named WARC fields, a map) and block (what follows
the fields). Blocks that are made here are text; lengths and digests count their UTF-8 bytes. Blocks
that are read are binary, and what is derived from them goes by their bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain, groupby
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.html_text import BLOCKS, TOKEN

CRLF = "\r\n"
VERSION = "WARC/1.1"
LINK = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)


def sha1_base32(block: Column) -> Column:
    """sha1: and the base-32 digest of a text's bytes, as WARC digest fields have it."""
    code = F.sha1(block.cast("binary"))
    fifth = lambda k: F.lpad(F.conv(F.substring(code, 10 * k + 1, 10), 16, 32), 8, "0")
    plain = F.translate(F.concat(*map(fifth, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(F.lit("sha1:"), plain)


def urn(*parts: Column) -> Column:
    """A record id that depends on parts alone, so that a task run again names its records alike."""
    code = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cuts = [F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cuts[0], F.lit("-"), cuts[1], F.lit("-8"), cuts[2], F.lit("-8"), cuts[3], F.lit("-"), cuts[4], F.lit(">"))


def fields(**named: Column) -> Column:
    """A map of WARC fields, without those that are null."""
    entries = F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("k"), v.cast("string").alias("v")) for k, v in named.items()))
    return F.map_from_entries(F.filter(entries, lambda x: x["v"].isNotNull()))


def octets(text: Column) -> Column:
    return F.octet_length(text.cast("binary")).cast("string")


def responses_from_pages(pages: DataFrame, captured: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and one response record for each row of pages (page_id, url, html; null html: an empty body)."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat_ws(CRLF, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), octets(body)))
    out = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("body"), F.concat(head, F.lit(CRLF * 2), body).alias("block"))
    named = fields(
        WARC_Target_URI=F.col("url"), WARC_Date=F.lit(captured), WARC_Payload_Digest=sha1_base32(F.col("body")), WARC_Block_Digest=sha1_base32(F.col("block")), Content_Type=F.lit("application/http; msgtype=response"), Content_Length=octets(F.col("block"))
    )
    return out.select("page_id", F.lit("response").alias("warc_type"), urn(F.lit("response"), F.col("page_id").cast("string"), F.col("url"), F.col("body")).alias("record_id"), named.alias("headers"), "block")


def page_parts(body: str, base: str) -> tuple[str, str | None, list[str]]:
    """Plain text (a line for each block, white space runs as one space), title and absolute links of a page."""
    lines, parts, links, at = [], [], [], 0

    def flush() -> None:
        if text := " ".join(unescape("".join(parts)).split()):
            lines.append(text)
        parts.clear()

    for m in TOKEN.finditer(body):
        parts.append(body[at : m.start()])
        at, tag = m.end(), (m[3] or "").lower()
        if tag in BLOCKS:
            flush()
        if tag == "a" and not m[2] and (href := LINK.search(m[4])):
            target = unescape("".join(x or "" for x in href.groups())).strip()
            try:
                links.append(urljoin(base, target))
            except ValueError:
                links.append(target)
    parts.append(body[at:])
    flush()
    title = TITLE.search(body)
    return "\n".join(lines), " ".join(unescape(title[1]).split()) if title else None, links


CONTENT_TYPE = re.compile(r"^content-type:\s*([^;\r\n]*)(?:[^\r\n]*?charset\s*=\s*\"?([\w.:-]+))?", re.I | re.M)
META_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def decoded(body: bytes, charset: str | None) -> str:
    """The text of a body: by the named character set, else the one a meta element names in its first 1024 bytes, else UTF-8."""
    if not charset and (meta := META_CHARSET.search(body[:1024])):
        charset = meta[1].decode("ascii", "replace")
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def response_parts(block: bytes, base: str) -> tuple[str, str, str, str | None, list[str]]:
    """HTTP head, payload digest, plain text, title and links of a response's block."""
    head, _, body = block.partition(b"\r\n\r\n")
    head_text = head.decode("utf-8", "replace")
    kind = CONTENT_TYPE.search(head_text)
    text, title, links = decoded(body, kind[2] if kind else None), None, []
    if not kind or kind[1].strip().lower() in ("text/html", "application/xhtml+xml"):
        text, title, links = page_parts(text, base)
    elif not kind[1].lower().startswith("text/"):
        text = ""
    return head_text, "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(), text, title, links


def derive(records: DataFrame) -> DataFrame:
    """For each response a metadata record and a conversion record; other records and clashing columns are left out.

    Both refer to the response (WARC-Refers-To, with its URI and date), carry its payload digest (its own
    field, or computed from its bytes where it has none) and name each other (WARC-Concurrent-To). The metadata block keeps the
    response's status line and HTTP headers, its title and its links in page order; the conversion block is the
    plain text of HTML, any other text payload as it is, or empty for other payloads. Columns of records besides warc_type, record_id,
    headers, fields and block stay. Null blocks are empty; repeated responses give repeated records, which share their ids; an
    empty table gives none.
    """
    names = [c for c in records.columns if c not in ("warc_type", "record_id", "headers", "block", "refers_to", "fields")]
    source = records.where("warc_type = 'response'").withColumn("block", F.coalesce(F.col("block").cast("binary"), F.lit("").cast("binary"))).select(*names, "record_id", "headers", "block")
    order = source.columns
    null = F.lit(None).cast("string")
    schema = source.drop("block").withColumns({"_head": null, "_own": null, "_text": null, "_title": null, "_links": F.lit(None).cast("array<string>")}).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, headers = (batch.column(order.index(c)).to_pylist() for c in ("block", "headers"))
            parts = [response_parts(block, dict(named or ()).get("WARC-Target-URI") or "") for block, named in zip(blocks, headers)]
            columns = list(zip(*parts)) or [[]] * 5
            made = [pa.array(list(c), k) for c, k in zip(columns, [pa.string()] * 4 + [pa.list_(pa.string())])]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k, c in enumerate(order) if c != "block"] + made, names=schema.names)

    read_ = source.mapInArrow(read, schema)
    header = lambda name: F.element_at("headers", F.lit(name))
    read_ = read_.withColumns({"_digest": F.coalesce(header("WARC-Payload-Digest"), "_own"), "_metadata_id": urn(F.lit("metadata"), F.col("record_id")), "_conversion_id": urn(F.lit("conversion"), F.col("record_id"))})
    named = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    metadata = F.concat_ws(
        CRLF,
        named("source-payload-digest", F.col("_digest")),
        F.transform(F.split("_head", CRLF), lambda x: F.concat(F.lit("source-http: "), x)),
        named("title", F.col("_title")),
        F.transform("_links", lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"\s", ""))),
    )
    records_of = F.explode(
        F.array(
            F.struct(F.lit("metadata").alias("warc_type"), F.col("_metadata_id").alias("record_id"), F.col("_conversion_id").alias("other"), F.lit("application/warc-fields").alias("kind"), F.concat(metadata, F.lit(CRLF)).alias("block")),
            F.struct(F.lit("conversion").alias("warc_type"), F.col("_conversion_id").alias("record_id"), F.col("_metadata_id").alias("other"), F.lit("text/plain; charset=utf-8").alias("kind"), F.col("_text").alias("block")),
        )
    )
    out = read_.select(*names, F.col("record_id").alias("refers_to"), "headers", "_digest", records_of.alias("x")).select(*names, "refers_to", "headers", "_digest", "x.*")
    made = fields(
        WARC_Refers_To=F.col("refers_to"), WARC_Refers_To_Target_URI=header("WARC-Target-URI"), WARC_Refers_To_Date=header("WARC-Date"), WARC_Target_URI=header("WARC-Target-URI"), WARC_Date=header("WARC-Date"), WARC_Concurrent_To=F.col("other"),
        WARC_Source_Payload_Digest=F.col("_digest"), WARC_Block_Digest=sha1_base32(F.col("block")), Content_Type=F.col("kind"), Content_Length=octets(F.col("block")),
    )
    return out.select(*names, "warc_type", "record_id", "refers_to", made.alias("headers"), "block")


def serialize(records: DataFrame) -> Column:
    """The bytes of a record, without the two line ends that close it. `fields`, where there, has all named fields in order."""
    listed = F.transform("fields", lambda x: F.concat_ws(": ", x["name"], x["value"])) if "fields" in records.columns else F.transform(F.map_entries("headers"), lambda x: F.concat_ws(": ", x["key"], x["value"]))
    head = F.concat(F.concat_ws(CRLF, F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.col("warc_type")), F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")), listed), F.lit(CRLF * 2))
    return F.concat(head.cast("binary"), F.coalesce(F.col("block").cast("binary"), F.lit("").cast("binary")))


CLOSING = gzip.compress(CRLF.encode() * 2, mtime=0)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files: each is followed by two line ends. Bytes are written as they are.

    gzip: a record begins a member of its own, so readers can start at any record's offset; the line ends that close it are a
    small member after it, which Spark's text writer adds as its separator. Files are written below path under a hidden
    name and then renamed to *.warc.gz; _SUCCESS comes last. Other names are Spark's codecs, over whole files. A path
    that is there is an error.
    """
    rows = records.select(serialize(records).alias("value"))
    if compression != "gzip":
        rows.select(F.col("value").cast("string")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)
        return

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(value.as_py(), mtime=0)], pa.binary())], names=["value"])

    spark = records.sparkSession
    at = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *parts)))
    files = at().getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at()):
        raise FileExistsError(path)
    hidden = f"_members-{uuid.uuid4().hex}"
    packed = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", CLOSING.decode("iso-8859-1")).option("encoding", "iso-8859-1").text(f"{path.rstrip('/')}/{hidden}")
    for status in files.listStatus(at(hidden)):  # a name a task, no data
        name = status.getPath().getName()
        if name.endswith(".txt") and not files.rename(at(hidden, name), at(name.removesuffix(".txt") + ".warc.gz")):
            raise OSError(f"{name} could not be renamed in {path}")
    files.delete(at(hidden), True)
    files.create(at("_SUCCESS")).close()


RECORD = "warc_type string, record_id string, headers map<string,string>, fields array<struct<name:string,value:string>>, block binary"
VERSION_LINE = re.compile(rb"WARC/[0-9.]+\s*\Z")


def records_in(chunks: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes, bool]]:
    """(named fields, block, whether it is whole) of the records in a file's bytes, cut by Content-Length; a file that ends early gives what it has.

    Between records lines are skipped until one holds a version alone. A field's continuation lines are joined by one space.
    """
    buffer, done = bytearray(), False

    def more() -> bool:
        nonlocal done
        chunk = next(chunks, None)
        done = chunk is None
        buffer.extend(chunk or b"")
        return not done

    def line() -> bytes | None:
        at = 0
        while (end := buffer.find(b"\n", at)) < 0:
            at = len(buffer)
            if done or not more():
                rest = bytes(buffer)
                buffer.clear()
                return rest or None
        found = bytes(buffer[: end + 1])
        del buffer[: end + 1]
        return found

    while (found := line()) is not None:
        if not VERSION_LINE.match(found):
            continue
        fields: list[tuple[str, str]] = []
        while (found := line()) is not None and found.strip():
            text = found.rstrip(b"\r\n").decode("utf-8", "replace")
            if text[0] in " \t" and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}")
            else:
                name, _, value = text.partition(":")
                fields.append((name.strip(), value.strip()))
        size = next((int(v) for n, v in fields if n.lower() == "content-length" and v.isdigit()), 0)
        while len(buffer) < size and not done and more():
            pass
        yield fields, bytes(buffer[:size]), found is not None and len(buffer) >= size
        del buffer[:size]


MARK = "WARC/"


def _parsed(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Records of pieces (_file, _from, bytes) that follow each other within a task; new values of keys begin anew.

    Pieces of plain files come without the letters that they were cut at: all but a file's first get them back. Where _from is
    NULL pieces are as they were. Records have _file, _from and _whole; keys end with a row of which all else is NULL.
    """
    columns = ["_file", "_from"]
    schema = f"_file string, _from long, {RECORD}, _whole boolean"
    kinds = pa.schema([("_file", pa.string()), ("_from", pa.int64()), *_RECORD_ARROW, ("_whole", pa.bool_())])
    ids = [columns.index(c) for c in keys]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(x.as_py() for x in row) for batch in batches for row in zip(*batch.columns))
        for _, own in groupby(rows, key=lambda r: [r[k] for k in ids]):
            head = next(own)
            mark = b"" if head[1] is None else MARK.encode()
            opening = head[2] if not head[1] else mark + head[2]
            place = dict(zip(columns, head))
            for fields, block, whole in records_in(chain([opening], (mark + r[2] for r in own))):
                first = dict(reversed([(n, v) for n, v in fields]))
                kept = [(n, v) for n, v in fields if n not in ("WARC-Type", "WARC-Record-ID")]
                row = place | {"warc_type": first.get("WARC-Type"), "record_id": first.get("WARC-Record-ID"), "headers": list(dict(reversed(kept)).items())[::-1]}
                row |= {"fields": [{"name": n, "value": v} for n, v in kept], "block": block, "_whole": whole}
                yield pa.RecordBatch.from_pylist([row], schema=kinds)
            yield pa.RecordBatch.from_pylist([place | dict.fromkeys(kinds.names[2:])], schema=kinds)

    return pieces.select(*columns, "bytes").mapInArrow(parse, schema)


def _records(parsed: DataFrame) -> DataFrame:
    return parsed.where("_whole is not null").select("warc_type", "record_id", "headers", "fields", "block")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, of any version and with any bytes: warc_type, record_id, headers, fields, block (binary).

    headers has the first value of each name but type and id, fields every field in order, repeated
    ones too. Gzipped files (*.gz) are read as a stream, one task a file. Others are read by ranges of spark.sql.files.maxPartitionBytes,
    however large they are: Spark's text reader cuts them at the letters that begin a version line, and a task joins what
    lies between two of them by Content-Length. A range that ends within a record leaves it open which of the next one's
    letters begin one (a block that quotes WARC files, or a file that is cut off and goes on); such files are taken again as a stream, in
    order of their pieces. Either way a task holds one record at a time. Finding those files takes a pass over the plain files of its own.
    """
    file = F.col("_metadata.file_path").alias("_file")
    zipped = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", "\n").text(path)
    zipped = zipped.select(file, F.lit(None).cast("long").alias("_from"), F.concat(F.col("value").cast("binary"), F.lit("\n").cast("binary")).alias("bytes"))

    plain = spark.read.option("pathGlobFilter", "*[!z]").option("lineSep", MARK).text(path)
    plain = plain.select(file, F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at"), F.col("value").cast("binary").alias("bytes"))
    ranges = _parsed(plain, ["_file", "_from"])
    ends = ranges.groupBy("_file").agg(F.max("_from").alias("_to"), F.min(F.when(~F.col("_whole"), F.col("_from"))).alias("_open"))
    torn = ends.where(F.col("_open") < F.col("_to")).select("_file")
    again = plain.join(torn, "_file", "left_semi").repartition("_file").sortWithinPartitions("_file", "_from", "_at")
    sound = ranges.join(torn, "_file", "left_anti")
    return _records(_parsed(zipped, ["_file"])).unionByName(_records(sound)).unionByName(_records(_parsed(again, ["_file"])))


_RECORD_ARROW = pa.schema(
    [("warc_type", pa.string()), ("record_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())]
)
