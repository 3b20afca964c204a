"""Field encryption with Spark's AES-GCM: ``enc:v1:`` before base64; written once, read through. Keys are bytes, or hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "enc:v1:"


def key_bytes(key: bytes | str) -> bytes:
    raw = bytes.fromhex(key) if isinstance(key, str) else key
    if len(raw) not in (16, 24, 32):
        raise ValueError(f"a key has 16, 24 or 32 bytes, not {len(raw)}")
    return raw


def is_encrypted(value: Column) -> Column:
    return F.coalesce(value.startswith(PREFIX), F.lit(False))


def encrypt(value: Column, key: bytes | str) -> Column:
    """Null and empty values, and ones that are encrypted already, stay as they are."""
    sealed = F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(value.cast("binary"), F.lit(key_bytes(key)), F.lit("GCM"))))
    return F.when(is_encrypted(value) | (value == ""), value).otherwise(sealed)


def decrypt(value: Column, key: bytes | str) -> Column:
    """Plain values pass; ones that were tampered with, or need another key, are null."""
    opened = F.try_aes_decrypt(F.unbase64(F.substring(value, len(PREFIX) + 1, 1 << 30)), F.lit(key_bytes(key)), F.lit("GCM")).cast("string")
    return F.when(is_encrypted(value), opened).otherwise(value)
