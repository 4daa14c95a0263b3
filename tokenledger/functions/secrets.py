"""Provider-key encryption (P17) and decryptability check.

AES-256-GCM with a random 12-byte nonce; the stored text is
``base64(nonce || ciphertext || tag)``, which is the layout Spark's
``aes_encrypt(..., 'GCM')`` produces. Plaintext is never emitted. Results are
named, so the key is in no column name, and every expression that holds a key
has the session redact 32-byte literals from plan texts and event logs.
"""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def parse_key(key: str) -> bytes:
    """A 32-byte key given as 64 hex digits, else as base64."""
    if not key:
        raise ValueError("empty encryption key")
    try:
        raw = bytes.fromhex(key)
    except ValueError:
        try:
            raw = base64.b64decode(key, validate=True)
        except binascii.Error as exc:
            raise ValueError("key is neither hex nor base64") from exc
    if len(raw) != 32:
        raise ValueError(f"key must be 32 bytes, got {len(raw)}")
    return raw


#: 32-byte literals as plans print them
KEY_LITERAL = "(?i)(0x|x')[0-9a-f]{64}'?"
_REDACTION = "spark.sql.redaction.string.regex"


def redact_keys(spark: SparkSession) -> None:
    """Adds key literals to what the session redacts."""
    rule = spark.conf.get(_REDACTION, None)
    if not rule:
        spark.conf.set(_REDACTION, KEY_LITERAL)
    elif KEY_LITERAL not in rule:
        spark.conf.set(_REDACTION, f"({rule})|({KEY_LITERAL})")


def _key(key: str) -> Column:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        redact_keys(spark)
    return F.lit(bytearray(parse_key(key)))


def encrypt_secret(c: Column, key: str) -> Column:
    """base64 of nonce, ciphertext and tag; random nonce per value."""
    return F.base64(F.aes_encrypt(c, _key(key), F.lit("GCM"))).alias("encrypted")


def secret_ok(c: Column, key: str) -> Column:
    """True when the value decrypts (bad base64, short, tampered or wrong key -> false)."""
    return _decrypted(c, key).isNotNull().alias("decryptable")


def secret_set(c: Column, key: str) -> Column:
    """True when the value decrypts to a text that is not empty."""
    return F.coalesce(F.octet_length(_decrypted(c, key)) > 0, F.lit(False)).alias("secret_set")


def _decrypted(c: Column, key: str) -> Column:
    data = F.try_to_binary(c, F.lit("base64"))
    return F.when(F.octet_length(data) >= 28, F.try_aes_decrypt(data, _key(key), F.lit("GCM")))
