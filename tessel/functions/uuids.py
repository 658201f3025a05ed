"""UUID functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nil UUID and the name spaces of RFC 4122.
NIL = "00000000-0000-0000-0000-000000000000"
NAMESPACES = {"dns": "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "url": "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "oid": "6ba7b812-9dad-11d1-80b4-00c04fd430c8", "x500": "6ba7b814-9dad-11d1-80b4-00c04fd430c8"}


def uuid_nil() -> Column:
    return F.lit(NIL)


def uuid_ns(name: str) -> Column:
    return F.lit(NAMESPACES[name])


def gen_random_uuid() -> Column:
    return F.uuid()


uuid_generate_v4 = gen_random_uuid


def _dashed(x: Column) -> Column:
    return F.concat_ws("-", *(F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _named(namespace: Column, name: Column, digest, version: int) -> Column:
    """Versions 3 and 5: the digest of the name space's bytes and the name, with version and variant put in."""
    x = F.lower(digest(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8"))))
    variant = F.lower(F.hex(F.conv(F.substring(x, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return _dashed(F.concat(F.substring(x, 1, 12), F.lit(str(version)), F.substring(x, 14, 3), variant, F.substring(x, 18, 15)))


def uuid_generate_v3(namespace: Column, name: Column) -> Column:
    return _named(namespace, name, F.md5, 3)


def uuid_generate_v5(namespace: Column, name: Column) -> Column:
    return _named(namespace, name, F.sha1, 5)


def uuid_generate_v1mc() -> Column:
    """Version 1: the time in 100 ns since 1582, a random clock sequence, and a random node address with the multicast bit. The
    statement's time is one for all rows, so the sequence and the node tell them apart."""
    ticks = F.lpad(F.lower(F.hex((F.unix_micros(F.current_timestamp()) * 10 + F.lit(0x01B21DD213814000)).cast("bigint"))), 16, "0")
    r = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    # of a random version 4 UUID the digit at 17 is a variant already; a node is multicast if its first byte is odd
    return F.concat_ws("-", F.substring(ticks, 9, 8), F.substring(ticks, 5, 4), F.concat(F.lit("1"), F.substring(ticks, 2, 3)), F.substring(r, 17, 4), F.concat(F.substring(r, 21, 1), F.lit("1"), F.substring(r, 23, 10)))


uuid_generate_v1 = uuid_generate_v1mc
