"""Scalar functions on keys, numbers and names.  All but the byte loops are native expressions.

Nulls give null.  Byte results are upper-case hexadecimal strings where the name
ends in ``_hex``; byte arguments of the UDFs are binary or string columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# Fixed values of the key and log formats.
MAX_SEQUENCE = (1 << 56) - 1
MASK_DELTA = 0xA282EAD8
HASH_MULTIPLIER = 0xC6A4A793
BLOOM_SEED = 0xBC9F1D34
KEY_SEED = 397
VALUE_TYPES = {"DEL": 0, "PUT": 1}

U32 = 0xFFFFFFFF


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack_sequence_and_type(seq, kind) -> Column:
    """Sequence number in the high 56 bits, value type in the low 8."""
    return F.shiftleft(col(seq), 8).bitwiseOR(col(kind))


def little_endian_hex(n) -> Column:
    """The eight bytes of a long, least significant first."""
    return F.concat_ws("", F.reverse(F.regexp_extract_all(F.lpad(F.hex(col(n)), 16, "0"), F.lit("(..)"), 1)))


def internal_key_hex(key, seq, kind) -> Column:
    """User key followed by the packed sequence and type, little endian."""
    return F.concat(F.hex(F.encode(col(key), "UTF-8")), little_endian_hex(pack_sequence_and_type(seq, kind)))


def _packed_of(internal_hex) -> Column:
    x = col(internal_hex)
    tail = F.substring(x, -16, 16)
    return F.conv(F.concat_ws("", F.reverse(F.regexp_extract_all(tail, F.lit("(..)"), 1))), 16, 10).cast("decimal(20,0)").cast("long")


def user_key_of(internal_hex) -> Column:
    """The user key of a hexadecimal internal key."""
    x = col(internal_hex)
    return F.decode(F.unhex(F.substring(x, F.lit(1), F.length(x) - 16)), "UTF-8")


def sequence_of(internal_hex) -> Column:
    return F.shiftrightunsigned(_packed_of(internal_hex), 8)


def value_type_of(internal_hex) -> Column:
    return _packed_of(internal_hex).bitwiseAND(F.lit(255)).cast("int")


def is_value_type(t) -> Column:
    """Deletion, value, merge or blob index."""
    return (col(t) <= 2) | (col(t) == 0x11)


def is_extended_value_type(t) -> Column:
    """A value type, or a range deletion."""
    return is_value_type(t) | (col(t) == 0xF)


def varint_length(n) -> Column:
    """Bytes of the variable-length form of a non-negative number: seven bits each."""
    n, out = col(n), F.lit(9)
    for size in range(8, 0, -1):
        out = F.when(n < (1 << 7 * size), size).otherwise(out)
    return F.when(n.isNotNull(), out)


def varint_hex(n) -> Column:
    """The variable-length form of a number, which is read as unsigned: seven bits a byte, least first, the top bit set on all but the last."""
    n = col(n)
    groups = F.transform(F.sequence(F.lit(0), F.lit(63), F.lit(7)), lambda i: F.call_function("shiftrightunsigned", n, i).bitwiseAND(F.lit(127)))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda top, i: F.when(F.call_function("shiftrightunsigned", n, i * 7) != 0, i).otherwise(top))
    bytes_ = F.transform(F.slice(groups, F.lit(1), last + 1), lambda g, i: F.lpad(F.hex(g + F.when(i < last, 128).otherwise(0)), 2, "0"))
    return F.when(n.isNotNull(), F.concat_ws("", bytes_))


def varint_value(x) -> Column:
    """The number at the start of a hexadecimal string in variable-length form; null if it is cut off."""
    x = col(x)
    size = F.length(F.regexp_extract(x, "^((?:[89A-F].)*[0-7].)", 1)) / 2
    digits = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.call_function("shiftleft", F.conv(F.substr(x, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127)), i * 7))
    return F.when(size > 0, F.aggregate(digits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def crc_mask(crc) -> Column:
    """Rotation right by 15 and a constant, modulo 2^32."""
    c = col(crc).cast("long")
    return (F.shiftright(c, 15).bitwiseOR(F.shiftleft(c, 17).bitwiseAND(F.lit(U32))) + MASK_DELTA).bitwiseAND(F.lit(U32))


def crc_unmask(masked) -> Column:
    """The inverse of crc_mask."""
    r = (col(masked).cast("long") - MASK_DELTA).bitwiseAND(F.lit(U32))
    return F.shiftright(r, 17).bitwiseOR(F.shiftleft(r, 15).bitwiseAND(F.lit(U32)))


def pack_file_number(number, path) -> Column:
    """Path id in the top two bits, file number below."""
    return col(number).cast("long").bitwiseOR(F.shiftleft(col(path).cast("long"), 62))


def path_id(packed) -> Column:
    return F.shiftrightunsigned(col(packed), 62)


def file_name(number, suffix: str) -> Column:
    """Six or more digits and a suffix."""
    n = col(number).cast("string")
    return F.concat(F.when(F.length(n) < 6, F.lpad(n, 6, "0")).otherwise(n), F.lit(f".{suffix}"))


def manifest_name(number) -> Column:
    n = col(number).cast("string")
    return F.concat(F.lit("MANIFEST-"), F.when(F.length(n) < 6, F.lpad(n, 6, "0")).otherwise(n))


def parse_file_type(name) -> Column:
    """current, manifest, log or table; null for any other name."""
    x = col(name)
    return F.when(x == "CURRENT", "current").when(x.rlike(r"^MANIFEST-\d+$"), "manifest").when(x.rlike(r"^\d+\.log$"), "log").when(x.rlike(r"^\d+\.sst$"), "table")


def parse_file_number(name) -> Column:
    """The number in a file name; 0 for CURRENT, null for names of no known type."""
    return F.when(col(name) == "CURRENT", F.lit(0).cast("long")).when(parse_file_type(name).isNotNull(), F.regexp_extract(col(name), r"(\d+)", 1).cast("long"))


def shared_prefix(a: str, b: str) -> Column:
    """Bytes that the binary forms of two string columns have in common at the start; 0 if one is null or empty."""
    x, y = f"hex(encode({a}, 'UTF-8'))", f"hex(encode({b}, 'UTF-8'))"
    least = f"least(length({x}), length({y}))"
    same = f"size(filter(sequence(2, {least}, 2), i -> substr({x}, 1, i) = substr({y}, 1, i)))"
    return F.expr(f"CASE WHEN {least} >= 2 THEN {same} ELSE 0 END")


def separator(start: bytes, limit: bytes) -> bytes:
    """A shortest key at or above ``start`` and below ``limit``; ``start`` if none is shorter."""
    common = next((i for i, (x, y) in enumerate(zip(start, limit)) if x != y), None)
    if common is None or start[common] >= limit[common]:
        return start
    if common + 1 < len(limit) or start[common] + 1 < limit[common]:
        return start[:common] + bytes([start[common] + 1])
    for i in range(common + 1, len(start)):
        if start[i] < 0xFF:
            return start[:i] + bytes([start[i] + 1])
    return start


def successor(key: bytes) -> bytes:
    """The first byte that can grow grows by one and ends the key."""
    at = next((i for i, x in enumerate(key) if x != 0xFF), None)
    return key if at is None else key[:at] + bytes([key[at] + 1])


def following(key: bytes) -> bytes:
    """The last byte grown by one, or a zero byte appended where it cannot grow (and to the empty key)."""
    return key[:-1] + bytes([key[-1] + 1]) if key and key[-1] < 0xFF else key + b"\0"


def _bytes(x):
    return x.encode() if isinstance(x, str) else bytes(x)


@F.pandas_udf(StringType())
def shortest_separator_hex(start: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else separator(_bytes(a), _bytes(b)).hex().upper() for a, b in zip(start, limit)])


@F.pandas_udf(StringType())
def short_successor_hex(key: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else successor(_bytes(x)).hex().upper() for x in key])


@F.pandas_udf(StringType())
def next_key_hex(key: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else following(_bytes(x)).hex().upper() for x in key])


def hash32(keys: list[bytes], seed: int) -> np.ndarray:
    """The 32-bit filter hash of each key; keys of one length are hashed together."""
    out = np.zeros(len(keys), np.int64)
    by_length: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_length.setdefault(len(k), []).append(i)
    for n, at in by_length.items():
        data = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), n).astype(np.uint64)
        h = np.full(len(at), (seed ^ n * HASH_MULTIPLIER) & U32, np.uint64)
        whole = n - n % 4
        for o in range(0, whole, 4):
            word = data[:, o] | data[:, o + 1] << 8 | data[:, o + 2] << 16 | data[:, o + 3] << 24
            h = (h + word & U32) * HASH_MULTIPLIER & U32
            h ^= h >> 16
        if n > whole:
            for i in range(n - whole - 1, -1, -1):
                h = h + (data[:, whole + i] << np.uint64(8 * i)) & U32
            h = h * HASH_MULTIPLIER & U32
            h ^= h >> 24
        out[at] = h.astype(np.int64)
    return out


def key_hash_udf(seed: int):
    """Vectorised 32-bit filter hash of a string or binary column."""

    @F.pandas_udf(LongType())
    def hashed(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = pd.Series(pd.NA, index=keys.index, dtype="Int64")
        out[known] = hash32([_bytes(x) for x in keys[known]], seed)
        return out

    return hashed
