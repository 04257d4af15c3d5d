"""WARC derivatives: metadata and plain-text conversion records that refer to their responses."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"

#: Elements whose content is no text, and elements that end a line.
SILENT = ("head", "script", "style", "noscript", "template")
BLOCKS = "p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|nav|header|footer|main|aside|body|html|blockquote|pre|form"

#: Character references, the ampersand last.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}


#: What follows the mark of a numeric character reference.
NUMBERED = "^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def _numbered(text: Column) -> Column:
    """Numeric character references resolved; those of no character stay."""

    def resolved(x: Column, i: Column) -> Column:
        said = F.regexp_extract(x, NUMBERED, 1)
        hexed = F.lower(F.substring(said, 1, 1)) == "x"
        code = F.when(hexed, F.conv(F.substring(said, 2, 6), 16, 10)).otherwise(said).try_cast("int")
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(i == 0, x).when(sound, F.concat(character, F.substr(x, F.length(said) + 2))).otherwise(F.concat(F.lit("&#"), x))

    # within a lambda, so that what makes the text is worked out once
    some = lambda t: F.when(F.contains(t, F.lit("&#")), F.array_join(F.transform(F.split(t, "&#"), resolved), "")).otherwise(t)
    return F.get(F.transform(F.array(text), some), F.lit(0))


def plain_text(html: Column) -> Column:
    """The text of a page: no comments, silent elements or tags; blocks on lines of their own; references resolved; white space collapsed."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in SILENT:
        text = F.regexp_replace(text, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = _numbered(text)
    for reference, character in REFERENCES.items():
        text = F.replace(text, F.lit(reference), F.lit(character))
    text = F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def record_id(kind: str, *of: Column) -> Column:
    """A URN for a record, the same on every run."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *of))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def fields(**named: Column) -> Column:
    """Header lines, without those whose value is null; line ends within values become spaces."""
    lines = [F.concat(F.lit(k.replace("_", "-") + ": "), F.regexp_replace(v.cast("string"), r"[\r\n]+", " "), F.lit(CRLF)) for k, v in named.items()]
    return F.concat(*(F.coalesce(x, F.lit("")) for x in lines))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of raw pages: ``page_id, response_id, target_uri, date, http_header, payload, payload_digest``. Null pages are empty."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        record_id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).alias("response_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF)).alias("http_header"),
        html.alias("payload"),
        F.concat(F.lit("sha256:"), F.sha2(html, 256)).alias("payload_digest"),
    )


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response: ``page_id, record_type, record_id, refers_to, header, block, block_digest``.

    The metadata record (``application/warc-fields``) keeps the status line and headers of the response, its payload
    digest and length, the title and the links in order of appearance. The conversion record holds the plain text. Both
    refer to the response by id, URI and date, carry the source's payload digest, and name each other in
    ``WARC-Concurrent-To``. All is one narrow projection: no shuffle, rows in as rows times two out.

    Payloads of any length are handled whole. No rows give no records. A null payload is empty and gives an empty conversion; a null URI, header or date leaves its line out. Repeated rows
    give repeated records. Columns beyond those of ``responses`` are left out.
    """
    payload, source = F.coalesce("payload", F.lit("")), F.coalesce("http_header", F.lit(""))
    header_lines = F.filter(F.split(source, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    header_lines = F.transform(header_lines, lambda x: F.concat(F.lit("http-header-"), F.lower(F.substring_index(x, ":", 1)), F.lit(": "), F.trim(F.substr(x, F.locate(":", x) + F.lit(1))), F.lit(CRLF)))
    links = F.transform(F.regexp_extract_all(payload, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), F.replace(x, F.lit("&amp;"), F.lit("&")), F.lit(" L a/@href" + CRLF)))
    title = F.regexp_extract(payload, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    facts = F.concat(
        fields(http_status=F.nullif(F.regexp_extract(source, r"^HTTP/\S+ (\d+)", 1), F.lit("")), payload_digest=F.col("payload_digest"), payload_length=F.octet_length(payload), title=F.nullif(title, F.lit(""))),
        F.array_join(header_lines, ""),
        F.array_join(links, ""),
    )
    ids = {k: record_id(k, F.col("response_id")) for k in ("metadata", "conversion")}
    kinds = F.array(*(F.struct(F.lit(k).alias("record_type"), ids[k].alias("record_id"), ids[other].alias("beside"), F.lit(mime).alias("mime"), block.alias("block")) for k, other, mime, block in (("metadata", "conversion", "application/warc-fields", facts), ("conversion", "metadata", "text/plain", plain_text(payload)))))
    rows = responses.select("page_id", "response_id", "target_uri", "date", "payload_digest", F.inline(kinds))
    digest = F.concat(F.lit("sha256:"), F.sha2("block", 256))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        fields(
            WARC_Type=F.col("record_type"), WARC_Record_ID=F.col("record_id"), WARC_Date=F.col("date"), WARC_Target_URI=F.col("target_uri"),
            WARC_Refers_To=F.col("response_id"), WARC_Refers_To_Target_URI=F.col("target_uri"), WARC_Refers_To_Date=F.col("date"), WARC_Concurrent_To=F.col("beside"),
            WARC_Source_Payload_Digest=F.col("payload_digest"), WARC_Block_Digest=digest, Content_Type=F.col("mime"), Content_Length=F.octet_length("block"),
        ),
    )
    return rows.select("page_id", "record_type", "record_id", F.col("response_id").alias("refers_to"), header.alias("header"), "block", digest.alias("block_digest"))


_FIELDS = ("response_id", "target_uri", "date", "http_header", "payload", "payload_digest")


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and blocks of a WARC file's records, plain or in gzip members; one that is cut short at the end, broken members and records without a readable length are left out."""

    def members() -> Iterator[bytes]:
        rest = content
        while rest:
            if rest[:2] != b"\x1f\x8b":
                yield rest
                return
            unpack = zlib.decompressobj(31)
            try:
                yield unpack.decompress(rest)
                rest = unpack.unused_data
            except zlib.error:  # a broken member: go on with the next
                following = rest.find(b"\x1f\x8b\x08", 2)
                rest = rest[following:] if following > 0 else b""

    held = b""
    for member in members():
        held, at = held + member, 0
        while (at := held.find(b"WARC/", at)) >= 0 and (end := held.find(b"\r\n\r\n", at)) >= 0:
            lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = header.get("content-length", "0")
            if not (length.isascii() and length.isdigit()):  # where its block ends is unknown: go on with the next record
                at = end + 4
                continue
            after = end + 4 + int(length)
            if len(held) < after:
                break
            yield header, held[end + 4 : after]
            at = after
        held = held[at:] if at >= 0 else b""


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, as ``responses`` has them: ``page_id`` (null), ids, URI, date, HTTP header, payload and digest, as the records say.

    Files are plain or in gzip members; each file is read by one task. Other record types are passed over, and so is a record that is cut
    short at the end, one whose length is no number, and a gzip member that is broken. Payloads are taken as UTF-8, other bytes are replaced. Without a digest in the record the payload's is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for header, block in _records(content.as_py()):
                    if header.get("warc-type") == "response":
                        said, _, payload = block.partition(b"\r\n\r\n")
                        row = [header.get("warc-record-id"), header.get("warc-target-uri"), header.get("warc-date"), (said + b"\r\n").decode("utf-8", "replace"), payload.decode("utf-8", "replace"), header.get("warc-payload-digest")]
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=list(_FIELDS))

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(run, ", ".join(f"{x} string" for x in _FIELDS))
    digest = F.coalesce("payload_digest", F.concat(F.lit("sha256:"), F.sha2("payload", 256)))
    return found.select(F.lit(None).cast("long").alias("page_id"), *_FIELDS[:-1], digest.alias("payload_digest"))


def response_records(responses: DataFrame) -> DataFrame:
    """Responses as records with ``header`` and ``block``, to be written."""
    block = F.concat(F.coalesce("http_header", F.lit("")), F.lit(CRLF), F.coalesce("payload", F.lit("")))
    named = fields(WARC_Type=F.lit("response"), WARC_Record_ID=F.col("response_id"), WARC_Date=F.col("date"), WARC_Target_URI=F.col("target_uri"), WARC_Payload_Digest=F.col("payload_digest"), Content_Type=F.lit("application/http; msgtype=response"), Content_Length=F.octet_length("block"))
    return responses.withColumn("block", block).select(F.concat(F.lit("WARC/1.1" + CRLF), named).alias("header"), "block")


#: Bytes of a record that one gzip member holds: below this the last byte of a member is zero.
MEMBER_BYTES = (1 << 24) - 1


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records (``header``, ``block``) as WARC files, one for each partition, with a gzip member for each record (more for one above 16 MB).

    Spark's text sink reaches any store but ends each value with a separator. A member ends with its size, whose last byte is zero; it is left
    off, and the separator is that byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.column("record"):
                raw = record.as_py().encode()
                for low in range(0, len(raw), MEMBER_BYTES):
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(raw[low : low + MEMBER_BYTES]) + pack.flush()
                    yield pa.RecordBatch.from_arrays([pa.array([member[:-1]], pa.binary())], names=["member"])

    whole = records.select(F.concat("header", F.lit(CRLF), "block", F.lit(CRLF * 2)).alias("record"))
    whole.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _oracle() -> str:
    text = "regexp_replace(payload, '(?s)<!--.*?-->', '', 'g')"
    for name in SILENT:
        text = rf"regexp_replace({text}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', '', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '(?i)</?(?:{BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    said = f"regexp_extract(x, '{NUMBERED}', 1)"
    code = f"CASE WHEN lower({said}) LIKE 'x%' THEN try_cast('0x' || substr({said}, 2) AS int) ELSE try_cast({said} AS int) END"
    one = f"CASE WHEN i = 1 THEN x WHEN ({code}) BETWEEN 1 AND 1114111 AND ({code}) NOT BETWEEN 55296 AND 57343 THEN chr({code}) || substr(x, length({said}) + 2) ELSE '&#' || x END"
    text = f"array_to_string(list_transform(string_split({text}, '&#'), lambda x, i: {one}), '')"
    for reference, character in REFERENCES.items():
        text = f"replace({text}, '{reference}', '{character.replace(chr(39), chr(39) * 2)}')"
    text = rf"trim(regexp_replace(regexp_replace({text}, '[ \t\x0B\f\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    urn = lambda x: f"'<urn:uuid:' || regexp_replace(md5({x}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') || '>'"
    end = "chr(13) || chr(10)"
    line = lambda name, value: rf"coalesce('{name}: ' || regexp_replace(({value})::varchar, '[\r\n]+', ' ', 'g') || {end}, '')"
    header = " || ".join(line(*x) for x in (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "'1970-01-01T00:00:00Z'"), ("WARC-Target-URI", "url"), ("WARC-Refers-To", "response_id"), ("WARC-Refers-To-Target-URI", "url"),
        ("WARC-Refers-To-Date", "'1970-01-01T00:00:00Z'"), ("WARC-Concurrent-To", "beside"), ("WARC-Source-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "'sha256:' || sha256(block)"), ("Content-Type", "mime"), ("Content-Length", "strlen(block)"),
    ))
    title = r"nullif(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '')"
    links = r"""array_to_string(list_transform(regexp_extract_all(payload, '(?i)<a\s[^>]*?href="([^"]*)"', 1), lambda x: 'outlink: ' || replace(x, '&amp;', '&') || ' L a/@href' || chr(13) || chr(10)), '')"""
    facts = f"{line('http-status', '200')} || {line('payload-digest', 'payload_digest')} || {line('payload-length', 'strlen(payload)')} || {line('title', title)} || 'http-header-content-type: text/html; charset=utf-8' || {end} || 'http-header-content-length: ' || strlen(payload) || {end} || {links}"
    return f"""
WITH r AS (SELECT page_id, url, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest, {urn("'response|' || coalesce(page_id::varchar, '') || '|' || coalesce(url, '')")} AS response_id FROM pages),
i AS (SELECT *, {urn("'metadata|' || response_id")} AS m, {urn("'conversion|' || response_id")} AS c FROM r),
d AS (SELECT page_id, url, payload_digest, response_id, 'metadata' AS record_type, m AS record_id, c AS beside, 'application/warc-fields' AS mime, {facts} AS block FROM i
      UNION ALL SELECT page_id, url, payload_digest, response_id, 'conversion', c, m, 'text/plain', {text} FROM i)
SELECT page_id, record_type, record_id, response_id AS refers_to, 'WARC/1.1' || {end} || {header} AS header, block, 'sha256:' || sha256(block) AS block_digest FROM d
"""


OP4_SQL = _oracle()
