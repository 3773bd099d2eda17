"""WARC derivatives: metadata and plain-text conversion records of fetched pages.

Every response gives two records that refer back to it by its identifier, address and date, and
keep its HTTP headers and payload digest. Identifiers are names (digests in UUID form): of a response's page, date,
address and payload, and of a derived record's kind and response, so a repeated task writes the same records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
EOL = "\r\n"
# Tags that end a line of text, and the entities that are decoded (ampersands last).
LINE_TAGS = "p|br|div|h1|h2|h3|h4|h5|h6|li|ul|ol|tr|td|th|table|nav|article|footer|header|title|section|blockquote|pre|body|head|html"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
HIDDEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LANGUAGE = r"""(?is)<html[^>]*\slang="([^"]*)\""""
LINK = r"""(?is)<a\s[^>]*href="([^"]*)\""""


def _decoded(text: Column) -> Column:
    for entity, letter in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return text


def plain_text(html: Column) -> Column:
    """Text without tags, scripts, styles and comments; one line for each block, single spaces, no empty lines.

    Entities beyond ENTITIES stay as written.
    """
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{LINE_TAGS})(?:\s[^>]*)?/?>", "\n")
    text = _decoded(F.regexp_replace(text, "<[^>]*>", ""))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages: page_id, record_id, target_uri, date, headers, payload, payload_digest.

    Null addresses and pages count as empty. Pages come without HTTP headers, so the least that a
    server sends is written.
    """
    payload = F.coalesce("html", F.lit(""))
    digest = F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))
    uri = F.coalesce("url", F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length(payload).cast("string")
    )
    return pages.select(
        "page_id", record_id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(date), uri, digest).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"),
        headers.alias("headers"), payload.alias("payload"), digest.alias("payload_digest"),
    )


def record_id(kind: str, *parts: Column) -> Column:
    name = F.md5(F.concat_ws("|", F.lit(kind), *parts).cast("binary"))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _metadata_block() -> Column:
    title = F.trim(F.regexp_replace(_decoded(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), "<[^>]*>", "")), r"\s+", " "))
    links = F.regexp_extract_all("payload", F.lit(LINK), F.lit(1))
    lines = F.split("headers", EOL)
    return F.concat_ws(
        EOL, F.concat(F.lit("title: "), title), F.concat(F.lit("language: "), F.regexp_extract("payload", LANGUAGE, 1)),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), _decoded(x))),
        # the source's own header lines
        F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.concat(F.lit("source-header: "), x)),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: page_id, record_type, record_id, refers_to, target_uri, content_type,
    content_length (bytes), block_digest, source_digest, header and block. Repeated rows give repeated records."""
    blocks = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), _metadata_block().alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    rows = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_digest"), F.inline(blocks))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("block").cast("binary"), 256))
    rows = rows.withColumn("block_digest", digest).withColumn("content_length", F.octet_length("block").cast("long"))
    name = F.when(F.col("record_type") == "metadata", record_id("metadata", F.col("refers_to"))).otherwise(
        record_id("conversion", F.col("refers_to"))
    )
    rows = rows.withColumn("record_id", name)
    # a line end in an address would end the header line
    uri = F.replace(F.replace(F.col("target_uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Refers-To-Target-URI: "), uri), F.concat(F.lit("WARC-Refers-To-Date: "), "date"),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), "source_digest"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    ]
    return rows.withColumn("header", F.concat_ws(EOL, *lines)).select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest", "header", "block",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzip-compressed WARC files, one for each partition, through Spark's own writer and its commit."""
    text = F.concat("header", F.lit(EOL + EOL), "block")
    records.select(text.alias("value")).write.option("lineSep", EOL + EOL).option("compression", "gzip").text(path)


def _decode_sql(text: str) -> str:
    for entity, letter in ENTITIES:
        quoted = letter.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    return text


def _uuid_sql(kind: str, rest: str) -> str:
    name = f"md5('{kind}|' || {rest})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({name}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_TEXT = f"regexp_replace(html, '{HIDDEN}', ' ', 'g')"
_TEXT = rf"regexp_replace({_TEXT}, '(?i)</?(?:{LINE_TAGS})(?:\s[^>]*)?/?>', chr(10), 'g')"
_TEXT = _decode_sql(f"regexp_replace({_TEXT}, '<[^>]*>', '', 'g')")
_TEXT = rf"regexp_replace({_TEXT}, '[ \t\r\f]+', ' ', 'g')"
_TEXT = rf"trim(regexp_replace({_TEXT}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
_TITLE = rf"trim(regexp_replace({_decode_sql(f"regexp_replace(regexp_extract(html, '{TITLE}', 1), '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g'))"
DERIVED_SQL = rf"""
with page as (
  select page_id, coalesce(url, '') as uri, coalesce(html, '') as html, 'sha256:' || sha256(coalesce(html, '')) as source_digest from pages
), fetched as (
  select *, {_uuid_sql('response', f"coalesce(page_id::varchar, '') || '|{DATE}|' || uri || '|' || source_digest")} as refers_to from page
), block as (
  select *, 'conversion' as record_type, {_uuid_sql('conversion', 'refers_to')} as record_id,
    'text/plain; charset=utf-8' as content_type, {_TEXT} as block from fetched
  union all
  select *, 'metadata', {_uuid_sql('metadata', 'refers_to')}, 'application/warc-fields',
    array_to_string(list_concat(
      ['title: ' || {_TITLE}, 'language: ' || regexp_extract(html, '{LANGUAGE}', 1)],
      list_transform(regexp_extract_all(html, '{LINK}', 1), lambda x: 'outlink: ' || {_decode_sql('x')}),
      ['source-header: Content-Type: text/html; charset=utf-8', 'source-header: Content-Length: ' || strlen(html)]
    ), chr(13) || chr(10)) from fetched
)
select page_id, record_type, record_id, refers_to, uri as target_uri, content_type, strlen(block)::bigint as content_length,
  'sha256:' || sha256(block) as block_digest, source_digest from block
"""
