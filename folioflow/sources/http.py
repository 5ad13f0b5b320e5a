"""Raw HTTP responses: heads as Columns, bodies by their framing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import table

HEAD_BYTES, VALUE_BYTES = 16 * 1024, 1024


def _header(head: Column, name: str) -> Column:
    """The value of a header, the first if it comes twice; null when it is absent or over 1 KiB."""
    value = F.regexp_extract(head, rf"(?im)^{name}[ \t]*:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(head.rlike(rf"(?im)^{name}[ \t]*:") & (F.octet_length(value) <= VALUE_BYTES), value)


def parse_head(head: Column) -> Column:
    """struct(status, etag, last_modified, location, content_encoding, date, content_length, chunked); status 0 if it is no response."""
    text = F.substring(head, 1, HEAD_BYTES)
    return F.struct(
        F.coalesce(F.regexp_extract(text, r"^HTTP/\d(?:\.\d)? +(\d{3})", 1).try_cast("int"), F.lit(0)).alias("status"),
        _header(text, "etag").alias("etag"),
        _header(text, "last-modified").alias("last_modified"),
        _header(text, "location").alias("location"),
        _header(text, "content-encoding").alias("content_encoding"),
        _header(text, "date").alias("date"),
        _header(text, "content-length").try_cast("bigint").alias("content_length"),
        F.coalesce(F.lower(_header(text, "transfer-encoding")).contains("chunked"), F.lit(False)).alias("chunked"),
    )


def read_body(raw: bytes, content_length: int | None, chunked: bool) -> tuple[bytes, bool]:
    """(body, whole) by chunks, by length, or to the end. A short body ends where its bytes do and isn't whole."""
    if not chunked:
        size = len(raw) if content_length is None else content_length
        return raw[:size], len(raw) >= size
    out, at = bytearray(), 0
    while True:
        end = raw.find(b"\n", at)
        if end < 0:
            return bytes(out), False
        size = raw[at:end].split(b";")[0].strip()
        try:
            n = int(size, 16)
        except ValueError:
            return bytes(out), False
        if n == 0:
            return bytes(out), True
        out += raw[end + 1 : end + 1 + n]
        at = end + 1 + n
        if at > len(raw):
            return bytes(out), False
        at += 2 if raw[at : at + 2] == b"\r\n" else 1


def http_head_parse(spark, sf_dir: str) -> DataFrame:
    """Heads of the fetch log that were written as text and read again."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")))
    head = F.concat(
        F.concat_ws(
            "\r\n",
            F.when(F.col("status") > 0, F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" X"))).otherwise("junk"),
            line("ETag", "etag"), line("last-modified", "last_modified"), line("Location", "location"), line("Content-Encoding", "content_encoding"), line("Date", "http_date"), line("Content-Length", "content_length"),
            F.when(F.col("chunked"), "Transfer-Encoding: chunked"),
        ),
        F.lit("\r\n\r\n"),
    )
    return table(spark, sf_dir, "http_heads").select("fetch_id", parse_head(head).alias("h")).select("fetch_id", "h.*")


HTTP_HEAD_SQL = """
select fetch_id, status, trim(etag) as etag, trim(last_modified) as last_modified, trim(location) as location, trim(content_encoding) as content_encoding, trim(http_date) as date,
  content_length, coalesce(chunked, false) as chunked from http_heads"""

QUERIES = {"http_head_parse": (http_head_parse, HTTP_HEAD_SQL)}
