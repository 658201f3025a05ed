"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

`responses` frames pages as WARC/1.1 response records. `derive` parses any column of such records and gives two records
for each: `conversion` (the page's plain text) and `metadata` (application/warc-fields with the HTTP status, the source's
HTTP header fields and the digests). Both keep the response's target URI and date, name it in WARC-Refers-To and carry
its payload digest as WARC-Source-Payload-Digest; the metadata record also names the conversion in WARC-Concurrent-To.
Record ids are derived from the response's id, so a task that runs again makes the same records.

Records may be gzip members. Of an HTTP payload the chunked coding, gzip and deflate are undone, and the text is read in the
charset that the header or a meta element names (UTF-8 where neither names a known one).

Null or empty html: a response with an empty payload and a conversion with an empty block. Null url: no target URI.
Record ids are made from id, url and payload: equal rows give equal records, any others different ones. A null record gives no
row; one that can't be parsed gives one row of type `error` with the reason, and all other rows are made. Very long pages are
read whole. Empty tables give empty results; ties don't occur; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import plain_text

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs (RFC 4122)
DATE = "2024-01-01T00:00:00Z"
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def _clean(value: str) -> str:
    return " ".join(value.split())


def write_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and out:  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return first, out


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record, whose length and block digest must hold."""
    if data[:2] == b"\x1f\x8b":
        data = _inflated(data, 31)
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, fields = _fields(head)
    if not first.startswith("WARC/1.") or not gap:
        raise WarcError("no WARC record")
    named = {k.lower(): v for k, v in fields}
    length = named.get("content-length", "")
    n = int(length) if length.isascii() and length.isdigit() else -1
    block = rest[: max(n, 0)]
    if n < 0 or len(block) < n:
        raise WarcError(f"{named.get('warc-record-id')}: cut off")
    if named.get("warc-block-digest", "").startswith("sha1:") and named["warc-block-digest"] != digest(block):
        raise WarcError(f"{named.get('warc-record-id')}: block digest differs")
    return named, block


def _inflated(data: bytes, bits: int) -> bytes:
    """All members of a zlib, gzip or raw stream."""
    out = []
    while data:
        stream = zlib.decompressobj(bits)
        try:
            out.append(stream.decompress(data) + stream.flush())
        except zlib.error as e:
            raise WarcError(f"broken compressed data: {e}") from None
        if not stream.eof:
            raise WarcError("compressed data are cut off")
        data = stream.unused_data if bits == 31 and stream.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at : max(end, at)].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise WarcError("broken chunked coding")
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
        if len(out[-1]) < n:
            raise WarcError("chunked coding is cut off")


def decoded(http: list[tuple[str, str]], payload: bytes) -> str:
    """The text of an HTTP payload."""
    named = {k.lower(): v for k, v in http}
    if "chunked" in named.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    for coding in reversed([x.strip().lower() for x in named.get("content-encoding", "").split(",") if x.strip()]):
        if coding in ("gzip", "x-gzip"):
            payload = _inflated(payload, 31)
        elif coding == "deflate":
            payload = _inflated(payload, 15 if payload[:1] and payload[0] & 15 == 8 and len(payload) > 1 and (payload[0] * 256 + payload[1]) % 31 == 0 else -15)
        elif coding != "identity":
            raise WarcError(f"content coding {coding[:40]}")
    found = _CHARSET.search(named.get("content-type", "").encode()) or _CHARSET.search(payload[:2048])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _response(key: str, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    target = [("WARC-Target-URI", url)] if url else []
    return write_record("response", [("WARC-Record-ID", record_id(f"{key} {url or ''} {digest(payload)}")), *target, ("WARC-Date", DATE), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")], block)


def _responses(batches):
    """Batches of id, url, key and html: id, url and record."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            made = [_response(*x) for x in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["__id", "__url", "record"])


def _pages(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    return pages.select(F.col(id_column).alias("__id"), F.col(url_column).cast("string").alias("__url"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("__key"), F.col(html_column).cast("string").alias("__html"))


def responses(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, record): a response record of every page."""
    a = pages.schema[id_column].dataType.simpleString()
    return _pages(pages, id_column, url_column, html_column).mapInArrow(_responses, f"__id {a}, __url string, record binary").withColumnsRenamed({"__id": id_column, "__url": url_column})


def derivatives(response: bytes) -> list[dict]:
    """The conversion and the metadata record of one response record."""
    source, block = read_record(response)
    if source.get("warc-type") != "response":
        raise WarcError(f"{source.get('warc-record-id')}: not a response")
    head, _, payload = block.partition(b"\r\n\r\n")
    status, http = _fields(head)
    found = digest(payload)
    if source.get("warc-payload-digest", found) != found:
        raise WarcError(f"{source.get('warc-record-id')}: payload digest differs")
    if not source.get("warc-record-id"):
        raise WarcError("no record id")
    refers, date, target = source["warc-record-id"], source.get("warc-date", ""), source.get("warc-target-uri")
    shared = [*([("WARC-Target-URI", target)] if target else []), ("WARC-Date", date), ("WARC-Refers-To", refers), *([("WARC-Refers-To-Target-URI", target)] if target else []), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", found)]
    ids = {k: record_id(f"{k} {refers}") for k in ("conversion", "metadata")}
    text = plain_text(decoded(http, payload)).encode("utf-8", "replace")
    facts = [("status", status), *((f"http-{k.lower()}", v) for k, v in http), ("source-block-digest", source.get("warc-block-digest", "")), ("source-payload-digest", found), ("source-length", str(len(payload))), ("conversion-id", ids["conversion"]), ("conversion-digest", digest(text)), ("conversion-length", str(len(text)))]
    meta = "".join(f"{k}: {_clean(v)}\r\n" for k, v in facts).encode()
    out = []
    for kind, mime, body, more in (("conversion", "text/plain; charset=utf-8", text, []), ("metadata", "application/warc-fields", meta, [("WARC-Concurrent-To", ids["conversion"])])):
        record = write_record(kind, [("WARC-Record-ID", ids[kind]), *shared, *more, ("Content-Type", mime)], body)
        out.append({"record_type": kind, "record_id": ids[kind], "refers_to": refers, "target_uri": target, "warc_date": date, "source_payload_digest": found, "source_block_digest": source.get("warc-block-digest"), "block_digest": digest(body), "content_length": len(body), "error": None, "record": record})
    return out


_DERIVED = pa.schema([(k, pa.string()) for k in ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "source_payload_digest", "source_block_digest", "block_digest")] + [("content_length", pa.int64()), ("error", pa.string()), ("record", pa.binary())])


_KINDS = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'bigint' if f.type == pa.int64() else 'string'}" for f in _DERIVED)


def _derive(batches):
    """Batches whose first column is an id and whose last one is a record: the records made of them."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            rows, ids = [], []
            for k, x in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if x is not None:
                    try:
                        made = derivatives(x)
                    except WarcError as e:
                        made = [{"record_type": "error", "error": str(e)}]
                    rows += made
                    ids += [k] * len(made)
            made = pa.RecordBatch.from_pylist(rows, schema=_DERIVED)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), *made.columns], names=["__id", *_DERIVED.names])


def derive(records: DataFrame, id_column: str = "page_id", record_column: str = "record") -> DataFrame:
    """Two rows a response: its conversion and its metadata record, whole, with their main fields. Null records give none, broken
    ones a row of type error."""
    a = records.schema[id_column].dataType.simpleString()
    return records.selectExpr(f"`{id_column}` as __id", f"`{record_column}` as __record").mapInArrow(_derive, f"__id {a}, {_KINDS}").withColumnRenamed("__id", id_column)


def derive_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """derive(responses(pages)) in one pass: the responses stay in the worker that made them, so a task has one worker, not two."""
    a = pages.schema[id_column].dataType.simpleString()
    return _pages(pages, id_column, url_column, html_column).mapInArrow(lambda batches: _derive(_responses(batches)), f"__id {a}, {_KINDS}").withColumnRenamed("__id", id_column)


def derived_digests(pages: DataFrame) -> DataFrame:
    """Every derived record of every page, the record itself as its SHA-256."""
    out = derive_pages(pages)
    return out.withColumn("record_bytes", F.octet_length("record").cast("bigint")).withColumn("record_sha256", F.sha2("record", 256)).drop("record")
