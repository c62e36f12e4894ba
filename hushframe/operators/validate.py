"""Validation of typed alerts: the first check that fails gives the code.

Codes, in the order of the checks: 1 a field is out of bounds, 2 the schema is another one, 3 the record cannot be serialized (never here), 4 the sensor's key is no point of its curve, 5 the signature has no valid form, 6 the signature does not fit, 7 the recipient's modulus has not 2048 bits, 8 the recipient's key is unusable, 9 the record is too long to encrypt, 10 the ciphertext is of something else; 0 is valid.

Codes 1, 2, 7 and 9 are found by native expressions, in checked(). Codes 4 to 6, 8 and 10 need arithmetic on large integers and run in operators.crypto.completed(), which puts all ten in order: a row that checked() gives 7 or 9 has 4, 5 or 6 if its signature fails as well.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import first_failure, text_ok
from ..functions.tokens import commitment, le, record_bytes

MESSAGES = {0: "valid", 1: "a field is out of bounds", 2: "made for another schema", 3: "not serializable", 4: "sensor key unreadable", 5: "signature unreadable", 6: "signature does not fit", 7: "recipient modulus has not 2048 bits", 8: "recipient key unusable", 9: "record too long to encrypt", 10: "ciphertext of something else"}
#: Bounds of a typed alert: fixed values.
EARLIEST, LATEST, MAX_SEVERITY, MAX_CATEGORY, MAX_PLAIN = 1_577_836_800, 4_102_444_800, 10, 4, 190
TEXTS = {"user": 32, "machine": 64, "process": 64, "ip": 45, "file_path": 128}
#: The schema that a commitment is made to: fields in the order of their bytes, each with its type and bounds, as JSON.
FIELDS = [["schema_version", "uint16", 1, 1], ["alert_id", "bytes", 16, 16], ["timestamp", "uint64", EARLIEST, LATEST], ["severity", "uint8", 1, MAX_SEVERITY], ["category", "uint8", 0, MAX_CATEGORY], *([c, "ascii", 1, n] for c, n in TEXTS.items())]
DESCRIPTOR = json.dumps({"record": "hushframe.alert", "byte_order": "little", "fields": FIELDS}, separators=(",", ":"))


def well_formed(at=F.col) -> Column:
    """All bounds of a typed alert; at gives the column of a field."""
    ok = (at("schema_version") == 1) & (F.octet_length(at("alert_id")) == 16) & (at("alert_id") != F.lit(bytearray(16)))
    ok = ok & at("timestamp").between(EARLIEST, LATEST) & at("severity").between(1, MAX_SEVERITY) & at("category").between(0, MAX_CATEGORY)
    for c, n in TEXTS.items():
        ok = ok & text_ok(at(c), n)
    return F.coalesce(ok, F.lit(False))


def alert_bytes(at=F.col) -> Column:
    return record_bytes(*[at(c) for c in ("schema_version", "alert_id", "timestamp", "severity", "category")], *[at(c) for c in TEXTS])


def native_code(descriptor: str = DESCRIPTOR) -> Column:
    """The first of the checks 1, 2, 7 and 9 that fails; columns as in checked()."""
    def at(c: str) -> Column:
        return F.col("alert")[c]

    modulus = F.col("recipient_modulus")
    top = F.conv(F.hex(F.substring(modulus, 1, 1)), 16, 10).cast("int") >= 128
    return first_failure((well_formed(at), 1), (F.col("schema_commitment") == commitment(F.lit(descriptor)), 2), ((F.octet_length(modulus) == 256) & top, 7), (F.octet_length(alert_bytes(at)) <= MAX_PLAIN, 9))


def message_of(code: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v))]), code)


def checked(witnesses: DataFrame, descriptor: str = DESCRIPTOR) -> DataFrame:
    """witnesses (alert struct, schema_commitment hex, recipient_modulus) with code and message of the native checks."""
    return witnesses.withColumn("code", native_code(descriptor)).withColumn("message", message_of(F.col("code")))


def public_bytes(ciphertext: Column, schema_commitment: Column, sensor_key: Column, key_hash: Column, campaign: Column, epoch: Column, nullifier: Column) -> Column:
    """What a valid witness makes public, as bytes: ciphertext and sensor key counted (eight bytes, the lowest first), hashes raw from hex, the epoch with the lowest byte first. 425 bytes with a ciphertext of 256 and a key of 33."""
    def counted(raw: Column) -> Column:
        return F.concat(le(F.octet_length(raw), 8), raw)

    return F.concat(counted(ciphertext), F.unhex(schema_commitment), counted(sensor_key), F.unhex(key_hash), campaign, le(epoch, 8), F.unhex(nullifier))
