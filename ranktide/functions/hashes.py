"""Deterministic ids: RFC 4122 name-based UUID (version 5, SHA-1) as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranktide.functions.util import as_col

# Fixed value: the RFC 4122 URL namespace.
NAMESPACE_URL_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name, namespace_hex: str = NAMESPACE_URL_HEX) -> Column:
    """``uuid5(namespace, name)`` in canonical 8-4-4-4-12 form (UTF-8 name bytes)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(as_col(name), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )
