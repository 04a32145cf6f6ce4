"""WARC derivatives: response records become metadata and plain-text conversion records linked to them.

Column expressions throughout; parse_records() and record_bytes() read and write the format itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

#: A response record: its WARC header fields, the HTTP status line and headers (in order), and the payload.
RESPONSE = "record_id string, target_uri string, date string, status string, headers array<struct<name:string,value:string>>, payload string"
#: Entities, the ampersand last so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Elements dropped with what they hold, and elements that end a line.
DROPPED = ("script", "style", "noscript", "template", "head")
BLOCKS = "p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|nav|main|article|section|header|footer|aside|title|body|blockquote|pre|form|option"


def digest(text: Column) -> Column:
    """Labelled digest of a UTF-8 text."""
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def uuid_of(*parts: Column) -> Column:
    """A record id that repeats: the MD5 of its parts as a URN."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def decode(text: Column) -> Column:
    for old, new in ENTITIES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def plain_text(html: Column) -> Column:
    """Readable text: comments and dropped elements go, block elements end lines, tags go, entities are decoded, white space is folded."""
    for name in DROPPED:
        html = F.regexp_replace(html, f"(?is)<{name}(?:\\s[^>]*)?>.*?</{name}\\s*>", " ")
    html = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    html = F.regexp_replace(html, f"(?i)</?(?:{BLOCKS})(?:\\s[^>]*)?/?>", "\n")
    html = decode(F.regexp_replace(html, "<[^>]*>", ""))
    html = F.regexp_replace(html, "[ \\t\\r\\f]+", " ")
    return F.regexp_replace(F.regexp_replace(html, " ?\\n[ \\n]*", "\n"), "^[ \\n]+|[ \\n]+$", "")


def responses_of(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as response records; null url and html are empty."""
    need(pages, "page_id", "url", "html")
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    headers = F.array(header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", F.octet_length(html).cast("string")))
    return pages.select("page_id", uuid_of(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"), url.alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.lit("HTTP/1.1 200 OK").alias("status"), headers.alias("headers"), html.alias("payload"))


def derive(responses: DataFrame) -> DataFrame:
    """Two rows for each response, whose columns are kept as far as they aren't replaced: a metadata and a conversion record.

    Added: warc_type, derived_id, refers_to (the response's id), content_type, payload_digest (the source payload's),
    block, block_digest, content_length. The metadata block has the source's status and every header in order (each as
    `source-<name>`), its payload digest and length, title and link count, and the id of the conversion; the
    conversion's block is the plain text. A null payload is empty; a null header list or header has no lines; a response
    without an id gives records that refer to null. Repeated responses give repeated records.
    """
    need(responses, "record_id", "target_uri", "date", "status", "headers", "payload")
    df = responses.withColumn("payload", F.coalesce("payload", F.lit("")))
    new_id = lambda kind: uuid_of(F.lit(kind), F.coalesce("record_id", F.lit("")), F.coalesce("target_uri", F.lit("")))
    df = df.withColumns({"payload_digest": digest(F.col("payload")), "_text": plain_text(F.col("payload")), "_conversion": new_id("conversion"), "_metadata": new_id("metadata")})
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")), F.lit("\r\n"))
    title = F.regexp_replace(decode(F.regexp_replace(F.regexp_extract("payload", "(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>", 1), "<[^>]*>", "")), "\\s+", " ")
    links = F.regexp_count("payload", F.lit("(?i)<a\\s[^>]*href"))
    sources = F.array_join(F.transform(F.filter(F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")), lambda h: h["name"].isNotNull()), lambda h: F.concat(F.lit("source-"), F.lower(h["name"]), F.lit(": "), F.coalesce(h["value"], F.lit("")), F.lit("\r\n"))), "")
    block = F.concat(line("source-status", F.col("status")), sources, line("source-payload-digest", F.col("payload_digest")), line("source-length", F.octet_length("payload").cast("string")), line("title", title), line("outlinks", links.cast("string")), line("conversion-id", F.col("_conversion")))
    record = lambda kind, own, content, text: F.struct(F.lit(kind).alias("warc_type"), F.col(own).alias("derived_id"), F.lit(content).alias("content_type"), text.alias("block"))
    df = df.withColumn("_r", F.explode(F.array(record("metadata", "_metadata", "application/warc-fields", block), record("conversion", "_conversion", "text/plain; charset=utf-8", F.col("_text")))))
    df = df.withColumns({"warc_type": F.col("_r.warc_type"), "derived_id": F.col("_r.derived_id"), "content_type": F.col("_r.content_type"), "block": F.col("_r.block"), "refers_to": F.col("record_id")})
    return df.withColumns({"block_digest": digest(F.col("block")), "content_length": F.octet_length("block").cast("long")}).drop("_r", "_text", "_conversion", "_metadata", "payload")


def record_bytes(df: DataFrame) -> DataFrame:
    """Adds `record`: each derived row as a WARC/1.1 record, header, block and closing blank lines."""
    fields = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "derived_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    head = F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")), F.lit("")) for name, c in fields))
    return df.withColumn("record", F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).cast("binary"))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an uncompressed WARC file; raises ValueError where it isn't one."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        yield head, block
        at = end + 8 + size
