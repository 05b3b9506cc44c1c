"""Exact and perceptual fingerprints.

A perceptual fingerprint is a BIGINT bit pattern made one way only (``left > right``, first comparison
in the highest bit). Fingerprints made another way carry another ``version`` and must never be joined
with these; a failed fingerprint is NULL, which no join matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scalars import ColumnLike, col

FINGERPRINT_VERSION = "neighbour-gt-msb-first"


def sha256_hex(content: ColumnLike) -> Column:
    return F.sha2(col(content), 256)


def neighbour_fingerprint(values: ColumnLike, comparisons: int = 63) -> Column:
    """Bit i is set when value i exceeds value i+1. NULL when the array is too short."""
    arr = col(values)
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(comparisons - 1)),
        F.lit(0).cast("bigint"),
        lambda acc, i: F.shiftleft(acc, 1) + (F.get(arr, i) > F.get(arr, i + F.lit(1))).cast("bigint"),
    )
    return F.when(F.size(arr) > comparisons, bits)


def hamming(a: ColumnLike, b: ColumnLike) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def payload_kind(content: ColumnLike) -> Column:
    """File extension from the leading bytes; PNG is the default."""
    head = F.hex(F.substring(col(content), 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("89504E47"), "png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .otherwise("png")
    )
