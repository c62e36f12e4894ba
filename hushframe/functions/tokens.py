"""Deterministic, type-separated tokens and hashes, from built-in functions only.

A token is HMAC-SHA256 under the key over type, a zero byte and the raw value: equal values of one type have equal tokens, and nothing else has. It therefore shows which rows share a value and how often; operators.leakage measures what that gives away.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NULLIFIER_DOMAIN, RECIPIENT_DOMAIN = "scoped-nullifier-v1", "rsa-recipient-v1"
SETTING = "spark.hushframe.token.secret"


@dataclass(frozen=True)
class Key:
    """The two padded halves of an HMAC-SHA256 key. Literals of them appear in plans: keep spark.redaction.regex and plan logs in mind."""

    inner: bytes
    outer: bytes

    @classmethod
    def of(cls, secret: bytes) -> Key:
        if len(secret) > 64:
            import hashlib

            secret = hashlib.sha256(secret).digest()
        block = secret.ljust(64, b"\0")
        return cls(bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block))

    @classmethod
    def from_session(cls, spark: SparkSession) -> Key:
        """From the setting SETTING, in hex."""
        return cls.of(bytes.fromhex(spark.conf.get(SETTING)))


#: For tests and the registered queries only.
TEST_KEY = Key.of(bytes(range(32)))


def binary(raw: bytes) -> Column:
    return F.lit(bytearray(raw))


def token(kind: str, raw: Column, key: Key = TEST_KEY) -> Column:
    """tok_{kind}_ and 32 hex digits; null stays null."""
    message = F.concat(binary(key.inner), binary(kind.encode() + b"\0"), F.encode(raw.cast("string"), "utf-8"))
    digest = F.sha2(F.concat(binary(key.outer), F.unhex(F.sha2(message, 256))), 256)
    return F.concat(F.lit(f"tok_{kind}_"), F.substring(digest, 1, 32))


def token_sql(kind: str, raw: str, key: Key = TEST_KEY) -> str:
    """token for DuckDB."""
    inner = f"sha256(unhex('{(key.inner + kind.encode() + bytes(1)).hex()}') || encode({raw}))"
    return f"('tok_{kind}_' || substr(sha256(unhex('{key.outer.hex()}') || unhex({inner})), 1, 32))"


def be64(n: Column) -> Column:
    """Eight bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def nullifier(secret: Column, campaign: Column, epoch: Column, domain: str = NULLIFIER_DOMAIN) -> Column:
    """SHA-256 of domain, secret, campaign and epoch: one value for each scope, in hex."""
    return F.sha2(F.concat(binary(domain.encode()), secret, campaign, be64(epoch)), 256)


def recipient_key_hash(modulus: Column, exponent: Column, domain: str = RECIPIENT_DOMAIN) -> Column:
    """SHA-256 of domain, the modulus' length in four bytes, modulus and exponent, in hex."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(modulus).cast("bigint")), 8, "0"))
    return F.sha2(F.concat(binary(domain.encode()), size, modulus, exponent), 256)


def commitment(descriptor: Column) -> Column:
    """SHA-256 of a schema's descriptor, in hex."""
    return F.sha2(descriptor.cast("binary"), 256)


def le(n: Column, size: int) -> Column:
    """So many bytes, the lowest first."""
    digits = F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def counted(text: Column) -> Column:
    """A text as eight bytes of length, the lowest first, and its UTF-8 bytes."""
    raw = F.encode(text, "utf-8")
    return F.concat(le(F.octet_length(raw), 8), raw)


def record_bytes(version: Column, alert_id: Column, timestamp: Column, severity: Column, category: Column, *texts: Column) -> Column:
    """The canonical bytes of a typed alert: integers with the lowest byte first, the identifier raw, texts counted."""
    return F.concat(le(version, 2), alert_id, le(timestamp, 8), le(severity, 1), le(category, 1), *[counted(t) for t in texts])
