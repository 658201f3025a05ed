"""Media columns: an Ogg container written to and read from a binary column.

A payload is cut into packets of PACKET bytes (8-bit samples, RATE a second). Packets go in turn to STREAMS logical
streams, whose pages are interleaved in one physical stream. Reading verifies each page's checksum, follows the lacing
values to reassemble packets (which may run over several pages), separates the logical streams by serial number, and
derives each packet's time from its page's granule position; the times order the packets of all streams again.

Nulls and empty texts give a payload of 64 zero bytes. Equal payloads give equal files: serial numbers are fixed.
A damaged file raises OggError, which names the page. Very long texts are stored whole, in as many pages as it takes. Each row is
handled for itself, so repeated rows, ties and null ids do not matter; empty tables give empty results; further columns are
not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

RATE, PACKET, STREAMS, SEGMENTS = 8000, 1024, 2, 48
_PAGE = struct.Struct("<4sBBqIIIB")
_HEAD = struct.Struct("<8sBBHIQ")
_CONTINUED, _FIRST, _LAST, _NONE = 1, 2, 4, -1
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, start 0: zlib's CRC on mirrored bytes, mirrored back."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(_PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def _pages(serial: int, head: bytes, packets: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The pages of a logical stream, each with the sample at which it is due."""
    out = [(-1, _page(serial, 0, _FIRST | (0 if packets else _LAST), 0, bytes([len(head)]), head))]
    lacing, body, granule, continued, due = bytearray(), bytearray(), _NONE, 0, 0

    def flush(flags: int, goes_on: int) -> None:
        nonlocal granule, continued
        out.append((due, _page(serial, len(out), continued | flags, granule, bytes(lacing), bytes(body))))
        lacing.clear(), body.clear()
        granule, continued = _NONE, goes_on

    for k, (end, packet) in enumerate(packets):
        at, due = 0, end
        while True:
            n = min(255, len(packet) - at)
            lacing.append(n)
            body += packet[at : at + n]
            at += n
            if n < 255:
                granule = end
                break
            if len(lacing) == SEGMENTS:
                flush(0, _CONTINUED)
        if k == len(packets) - 1:
            flush(_LAST, 0)
        elif len(lacing) == SEGMENTS:
            flush(0, 0)
    return out


def encode(payload: bytes) -> bytes:
    """An Ogg file of a payload whose length is a multiple of 64, at least 64."""
    packets = [(min(at + PACKET, len(payload)), payload[at : at + PACKET]) for at in range(0, len(payload), PACKET)]
    pages = []
    for s in range(STREAMS):
        head = _HEAD.pack(b"\x01pcm8dmx", STREAMS, s, PACKET, RATE, len(payload))
        pages += [(due, s, page) for due, page in _pages(s + 1, head, packets[s::STREAMS])]
    pages.sort(key=lambda x: x[:2])
    return b"".join(x[2] for x in pages)


def pages_of(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, int]]:
    """(serial, number, flags, granule, lacing, body's place) of each page whose checksum holds."""
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError(f"page at {at}: cut off")
        magic, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(data):
            raise OggError(f"page at {at}: bad header")
        if checksum(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]))) != crc:
            raise OggError(f"page at {at}: bad checksum")
        yield serial, number, flags, granule, lacing, body
        at = end


def packets_of(data: bytes) -> dict[int, list[tuple[int, bytes]]]:
    """By serial number: the packets, each with its page's granule position (-1 but for the last packet that ends on a page)."""
    streams: dict[int, dict] = {}
    for serial, number, flags, granule, lacing, at in pages_of(data):
        s = streams.setdefault(serial, {"next": 0, "open": None, "packets": [], "ended": False})
        if number != s["next"] or s["ended"] or bool(flags & _FIRST) != (number == 0) or bool(flags & _CONTINUED) != (s["open"] is not None):
            raise OggError(f"stream {serial}: page {number} is out of order")
        s["next"], s["ended"] = number + 1, bool(flags & _LAST)
        parts, ended = s["open"] or [], 0
        for n in lacing:
            parts.append(data[at : at + n])
            at += n
            if n < 255:
                s["packets"].append((-1, b"".join(parts)))
                parts, ended = [], ended + 1
        s["open"] = parts or None
        if ended:
            s["packets"][-1] = (granule, s["packets"][-1][1])
    for serial, s in streams.items():
        if s["open"] is not None or not s["ended"]:
            raise OggError(f"stream {serial}: no end")
    return {k: s["packets"] for k, s in streams.items()}


def decode(data: bytes) -> tuple[bytes, list[tuple[int, int, int, bytes]]]:
    """The payload, and each packet as (first sample, end sample, serial, bytes) in order of time."""
    timed, total = [], 0
    for serial, packets in packets_of(data).items():
        magic, n, mine, size, _, total = _HEAD.unpack(packets[0][1])
        if magic != b"\x01pcm8dmx" or mine >= n:
            raise OggError(f"stream {serial}: unknown codec")
        end = None
        for granule, body in reversed(packets[1:]):  # a packet before one at a known time is as far away as the streams' turns say
            end = granule if granule >= 0 else end - len(after) - size * (n - 1)
            after = body
            timed.append((end - len(body), end, serial, body))
    timed.sort(key=lambda x: x[0])
    at = 0
    for start, end, serial, _ in timed:
        if start != at:
            raise OggError(f"stream {serial}: a gap at sample {at}")
        at = end
    if at != total:
        raise OggError(f"{at} of {total} samples")
    return b"".join(x[3] for x in timed), timed


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def _slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `most` bytes, so that what is built from one stays small."""
    at, held = 0, 0
    for i, x in enumerate(batch.column(column)):
        held += len(x.as_py() or "") if x.is_valid else 0
        if held > most:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def store(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as an Ogg file. Other columns of df are not read."""

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, "__text"):
                made = [payload_of(x) for x in batch.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array([n for n, _ in made], pa.int64()), pa.array([encode(p) for _, p in made], pa.binary())], names=["__id", "n_bytes", "media"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.selectExpr(f"`{id_column}` as __id", f"cast(`{text_column}` as string) as __text").mapInArrow(run, f"__id {kind}, n_bytes bigint, media binary").withColumnRenamed("__id", id_column)


def probe(df: DataFrame, id_column: str = "doc_id", media_column: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Each file's payload read back, with its digests, timing and a feature: pages, packets and length by stream, mean and spread of the samples."""

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, "__media"):
                rows = []
                for media in batch.column("__media").to_pylist():
                    payload, timed = decode(media)
                    by = [sum(1 for x in timed if x[2] == s + 1) for s in range(STREAMS)]
                    zero, lines, blanks = payload.count(0), payload.count(10), payload.count(32)
                    feature = f"samples={len(payload)};seconds={timed[-1][1] / RATE:.4f};packets={','.join(map(str, by))};last_start={timed[-1][0]};zero={zero};lf={lines};sp={blanks};crc={zlib.crc32(payload):08x}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("__id"), *(batch.column(f"__k{i}") for i in range(len(keep))), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["__id", *(f"__k{i}" for i in range(len(keep))), *_PROBED])

    kind = df.schema[id_column].dataType.simpleString()
    kept = "".join(f", __k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))
    out = df.selectExpr(f"`{id_column}` as __id", *(f"`{k}` as __k{i}" for i, k in enumerate(keep)), f"`{media_column}` as __media")
    out = out.mapInArrow(run, f"__id {kind}{kept}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return out.withColumnsRenamed({"__id": id_column, **{f"__k{i}": k for i, k in enumerate(keep)}})


_PROBED = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_digests(documents: DataFrame) -> DataFrame:
    return probe(store(documents))
