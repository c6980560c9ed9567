"""Deterministic ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

RECORDS = uuid.uuid5(uuid.NAMESPACE_URL, "evidencia/records")
CHUNKS = uuid.uuid5(uuid.NAMESPACE_URL, "evidencia/chunks")


def uuid5(namespace: uuid.UUID, key: Column) -> Column:
    """Name-based UUID (RFC 4122, version 5), computed with SHA-1 inside the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(key, "UTF-8")))
    nibble = F.instr(F.lit("0123456789abcdef"), F.substring(digest, 17, 1)) - 1
    variant = F.substr(F.lit("89ab"), F.pmod(nibble, F.lit(4)) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )
