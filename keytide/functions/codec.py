"""Checksummed log frames and membership sketches, as column expressions.

A frame is: length of the payload (4 bytes), its CRC32 (4 bytes), the payload, and an end byte. A payload is a tag and

* put: the length of the key (4 bytes), key, value
* put with expiry: the expiry (4 bytes, epoch seconds), the length of the key (4 bytes), key, value
* delete: the key; delete with expiry: the expiry (4 bytes), the key
* pointer: a position (8 bytes), a length (4 bytes), the key; it stands in an index of pages and never in a log of changes
* transaction: the frames of its members

All numbers are unsigned and big-endian. A transaction is one frame, so it is read whole or not at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format.
PUT, DELETE, POINTER, TRANSACTION, PUT_EXPIRING, DELETE_EXPIRING, END = 0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0xFF


def big_endian(c: Column, size: int) -> Column:
    return F.to_binary(F.lpad(F.hex(c.cast("long")), 2 * size, F.lit("0")), F.lit("hex"))


def be32(c: Column) -> Column:
    return big_endian(c, 4)


def byte(v: int) -> Column:
    return F.lit(bytearray([v]))


def payload(key: Column, value: Column, is_delete: Column, expire_at: Column) -> Column:
    """Of a change. An expiry that four bytes can't hold is written as the last second that they can."""
    at = be32(F.greatest(F.lit(0), F.least(expire_at, F.lit(0xFFFFFFFF))))
    body = F.concat(be32(F.octet_length(key)), key, F.coalesce(value, F.lit(bytearray())))
    return (
        F.when(is_delete & expire_at.isNull(), F.concat(byte(DELETE), key)).when(is_delete, F.concat(byte(DELETE_EXPIRING), at, key))
        .when(expire_at.isNull(), F.concat(byte(PUT), body)).otherwise(F.concat(byte(PUT_EXPIRING), at, body))
    )


def pointer(key: Column, position: Column, length: Column) -> Column:
    return F.concat(byte(POINTER), big_endian(position, 8), be32(length), key)


def frame(body: Column) -> Column:
    return F.concat(be32(F.octet_length(body)), be32(F.crc32(body)), body, byte(END))


def transaction(frames: Column) -> Column:
    """One frame around an array of frames."""
    return frame(F.concat(byte(TRANSACTION), F.aggregate(frames, F.lit(bytearray()), lambda a, x: F.concat(a, x))))


def frame_ok(framed: Column) -> Column:
    """Whether length, checksum and end byte of a single frame hold."""
    n = F.octet_length(framed) - 9
    body = F.substring(framed, F.lit(9), n)
    sound = (F.substring(framed, 1, 4) == be32(n)) & (F.substring(framed, 5, 4) == be32(F.crc32(body))) & (F.substring(framed, n + 9, F.lit(1)) == byte(END))
    return F.when(n < 0, F.lit(False)).otherwise(sound)


Change = tuple[bytes, bytes | None, bool, int | None]


def change(body: bytes) -> Change | None:
    """Key, value, whether it is a delete, and expiry of a payload; None for anything that isn't a change."""
    tag, size = body[:1], len(body)
    at = 5 if tag in (bytes([PUT_EXPIRING]), bytes([DELETE_EXPIRING])) else 1
    expiry = int.from_bytes(body[1:5], "big") if at == 5 else None
    if tag in (bytes([DELETE]), bytes([DELETE_EXPIRING])) and size >= at:
        return body[at:], None, True, expiry
    if tag in (bytes([PUT]), bytes([PUT_EXPIRING])) and size >= at + 4:
        end = at + 4 + int.from_bytes(body[at : at + 4], "big")
        if end <= size:
            return body[at + 4 : end], body[end:], False, expiry
    return None


def parse(data: bytes) -> Iterator[Change | None]:
    """Changes of a log in order; None for each stretch of broken bytes.

    A frame with a wrong checksum, an unknown tag or (in a transaction) a broken member is left out as a whole. Where
    length and end byte don't fit, the next sound frame is sought after the next end byte; but of a transaction that
    is cut off by the log's end no member is read.
    """
    i, broken = 0, False
    while i < len(data):
        end = i + 8 + int.from_bytes(data[i : i + 4], "big")
        if end < len(data) and data[end] == END:
            body, found = data[i + 8 : end], None
            if zlib.crc32(body) == int.from_bytes(data[i + 4 : i + 8], "big"):
                found = list(parse(body[1:])) if body[:1] == bytes([TRANSACTION]) else [change(body)]
            i = end + 1
            if found is not None and None not in found:
                broken = False
                yield from found
                continue
        elif data[i + 8 : i + 9] == bytes([TRANSACTION]) and end >= len(data):
            i = len(data)
        else:
            at = data.find(bytes([END]), i)
            i = len(data) if at < 0 else at + 1
        if not broken:
            yield None
            broken = True


#: Bits of a filter's block at most; all bits of a key are in one block.
BLOOM_BLOCK = 32_768


def bloom_bits(count: int, error: float = 0.01) -> tuple[int, int]:
    """Bits and hashes of a filter for ``count`` keys. The bits make blocks of one size."""
    import math

    bits = max(64, math.ceil(-count * math.log(error) / math.log(2) ** 2))
    blocks = -(-bits // BLOOM_BLOCK)
    return -(-bits // blocks) * blocks, max(1, round(bits / max(count, 1) * math.log(2)))


def bloom_block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), blocks)


def bloom_positions(key: Column, width: Column, hashes: Column) -> Column:
    """Where the key's bits are in its block of ``width`` bits."""
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: F.pmod(F.xxhash64(key, i), width.cast("long")))
