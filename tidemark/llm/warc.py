"""WARC archives: writing page captures and assembling transactions on reading.

Writing. Each page becomes a transaction of three records: a request, a response (or a
revisit of an earlier response with an equal payload) and a metadata record; the request
and the metadata name the response's record id in WARC-Concurrent-To. A record ends with
two CRLF, which is exactly Spark's text sink with lineSep CRLF CRLF, so archives are
written by Spark's own committer to any Hadoop file system, gzip-compressed.

Reading. The text source with the same separator streams the chunks of one archive file in
order to a parser, which rebuilds the byte stream and cuts records by Content-Length, so
payloads may hold any bytes. Memory is bounded by the longest record. The records are then
joined through their concurrent-to identifiers into one nested row per capture.

Record ids are UUID-shaped: a 128-bit digest of page_id, position and kind; no two rows
share one, also when a page_id repeats.

Defined cases: null html counts as an empty payload. A null url gives an empty target URI.
CR and LF in a url are percent-encoded. A null page_id is kept (as an empty header value)
and sorts last when the smallest page_id of equal payloads is sought. Of rows with equal
page_id and payload the smallest hash of the url is the response; of rows equal in all three
columns one is. Payloads of fewer than ``min_revisit_bytes`` bytes are never revisits. Extra columns are ignored. An
empty table gives an empty archive and no captures.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, materialize, scratch, sized

CRLF = "\r\n"
BLANK = CRLF + CRLF
#: Fixed value: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hex digits are 4 digits of base 32."""
    digits = []
    hexed = F.sha1(payload)
    for i in range(0, 40, 5):
        v = F.conv(F.substring(hexed, i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(fields: list[tuple[str, Column | str]], body: Column) -> Column:
    """A record without its closing blank lines. Fields with a null value are left out."""
    lines: list[Column] = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        v = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), v, F.lit(CRLF)), F.lit("")))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(BLANK))
    return F.concat(*lines, length, body)


def write_archive(
    pages: DataFrame,
    path: str,
    min_revisit_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write pages as gzip-compressed WARC files under path."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        html.alias("html"),
    )
    digests = materialize(
        base.select(
            "page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("long").alias("n_bytes"),
            F.xxhash64("url").alias("url_hash"),
        ),
        "payloads",
    )
    each = digests.groupBy("sha", "n_bytes", "page_id", "url_hash").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url_hash", "copies"))
    many = each.groupBy("sha", "n_bytes").agg(first.alias("first"), F.sum("copies").alias("n"))
    firsts = materialize(
        many.filter((F.col("n") > 1) & (F.col("n_bytes") >= min_revisit_bytes)).select(
            F.col("sha").alias("f_sha"), F.col("first.page_id").alias("f_id"), F.col("first.url_hash").alias("f_url"), F.col("first.copies").alias("f_copies")
        ),
        "first-captures",
    )
    page = base.withColumns({"sha": F.sha2("html", 256), "url_hash": F.xxhash64("url"), "seq": F.monotonically_increasing_id()})
    page = page.join(sized(firsts), F.col("sha") == F.col("f_sha"), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("f_id")) & (F.col("url_hash") == F.col("f_url"))
    page = page.withColumn("revisit", F.col("f_sha").isNotNull() & ~is_first)
    if firsts.filter("f_copies > 1").limit(1).count():
        # Rows equal in all columns: written down with their numbers, of which the smallest is the response.
        same = F.coalesce(F.col("f_copies") > 1, F.lit(False)) & ~F.col("revisit")
        copies = materialize(page.filter(same), "repeated-pages")
        low = materialize(copies.groupBy("sha").agg(F.min("seq").alias("low")), "first-copies")
        marked = copies.join(sized(low), "sha").withColumn("revisit", F.col("seq") != F.col("low")).select(page.columns)
        tagged = lambda df, t: df.withColumn("seq", F.concat(F.lit(t), F.col("seq").cast("string")))
        page = tagged(page.filter(~same), "a").unionByName(tagged(marked, "b"))
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    me = _uuid(F.lit("capture"), F.col("page_id"), F.col("seq"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("html").cast("string"), F.lit(BLANK),
    )
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url")), ("WARC-Page-ID", pid)]
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))
    only = F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers = F.when(F.col("revisit"), F.coalesce(F.col("f_id").cast("string"), F.lit("")))
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _uuid(F.lit("request"), F.col("page_id"), F.col("seq"))),
         ("WARC-Concurrent-To", me), *common, ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(BLANK)),
    )
    response = _record(
        [("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", me), *common,
         ("WARC-Payload-Digest", digest), ("WARC-Profile", only), ("WARC-Refers-To-Page", refers),
         ("Content-Type", "application/http; msgtype=response")],
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))),
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _uuid(F.lit("metadata"), F.col("page_id"), F.col("seq"))),
         ("WARC-Concurrent-To", me), *common, ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("payload-bytes: "), F.octet_length("html").cast("string"), F.lit(CRLF)),
    )
    page.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option("lineSep", BLANK).option(
        "compression", "gzip"
    ).text(path)


RECORD = (
    "warc_type string, record_id string, concurrent_to string, page_id string, url string, date string, "
    "refers_to string, declared_digest string, payload_digest string, payload_bytes long, body binary"
)


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    return out


def _row(head: dict[str, str], content: bytes, keep_body: bool) -> dict:
    """A parsed record. For http responses the payload is what follows the http head."""
    kind = head.get("warc-type", "")
    payload, size = content, len(content)
    digest = None
    if kind in ("response", "revisit"):
        top, _, payload = content.partition(b"\r\n\r\n")
        size = len(payload)
        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if declared and declared != digest:
                raise ValueError(f"record {head.get('warc-record-id')}: payload does not match its digest")
        else:
            digest, size = declared, int(_headers(top).get("content-length", "0"))
    return {
        "warc_type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"),
        "page_id": head.get("warc-page-id"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"),
        "refers_to": head.get("warc-refers-to-page"), "declared_digest": head.get("warc-payload-digest"),
        "payload_digest": digest, "payload_bytes": size, "body": payload if keep_body else None,
    }


class _Stream:
    """Cuts records from the byte stream of one file, fed chunk by chunk."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.have = 0
        self.need = 0
        self.head: dict[str, str] | None = None

    def feed(self, chunk: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.parts.append(chunk)
        self.have += len(chunk)
        while self.have >= self.need:
            data = b"".join(self.parts)
            if self.head is None:
                while data.startswith(b"\r\n"):  # between records
                    data = data[2:]
                head, found, rest = data.partition(b"\r\n\r\n")
                if not found:
                    self.parts, self.have, self.need = [data], len(data), len(data) + 1
                    return
                self.head, data = _headers(head), rest
                self.need = int(self.head["content-length"])
            if len(data) < self.need:
                self.parts, self.have = [data], len(data)
                return
            yield self.head, data[: self.need]
            data = data[self.need :]
            self.parts, self.have, self.need, self.head = [data], len(data), 1, None


def _parser(keep_body: bool, schema: pa.Schema):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, rows, held = None, _Stream(), [], 0
        for batch in batches:
            for file, chunk in zip(batch["file"].to_pylist(), batch["chunk"], strict=True):
                if file != name:
                    if stream.head is not None:
                        raise ValueError(f"{name}: the last record is cut off")
                    name, stream = file, _Stream()
                for head, content in stream.feed(chunk.as_py() + b"\r\n\r\n"):
                    rows.append(_row(head, content, keep_body))
                    held += len(content)
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if stream.head is not None:
            raise ValueError(f"{name}: the last record is cut off")
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return parse


def read_records(spark: SparkSession, path: str, keep_body: bool = True) -> DataFrame:
    """The records of all archive files under path; body is null unless keep_body."""
    chunks = (
        spark.read.option("lineSep", BLANK).text(path)
        .select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("chunk"))
    )
    ints = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, ints[t]) for n, t in (f.split() for f in RECORD.split(", "))])
    return in_batches(chunks, _parser(keep_body, schema), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata structs.

    request or metadata is null for a capture without one. Records concurrent to no
    capture of the archive are left out.
    """
    at = materialize(records, "records")
    whole = F.struct(*[F.col(c) for c in at.columns])
    main = at.filter("warc_type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    side = at.filter("warc_type in ('request', 'metadata')").groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.first(F.when(F.col("warc_type") == "request", whole), ignorenulls=True).alias("request"),
        F.first(F.when(F.col("warc_type") == "metadata", whole), ignorenulls=True).alias("metadata"),
    )
    return main.join(side, "capture_id", "left").select("capture_id", "request", "response", "metadata")


def captures(pages: DataFrame, min_revisit_bytes: int = 0, keep_body: bool = False) -> DataFrame:
    """Write pages to an archive in the shared folder, read it back, assemble."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archive(pages, path, min_revisit_bytes)
    return assemble(read_records(spark, path, keep_body))
