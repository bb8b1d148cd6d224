"""Expressions over what a rendering crawler hands in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

LEAST_BYTES, SHARE = 2048, 0.5


def under_rendered(raw_bytes: Column, rendered_bytes: Column) -> Column:
    """Whether rendering lost most of a page of some size."""
    return (raw_bytes >= LEAST_BYTES) & (rendered_bytes < SHARE * raw_bytes)


def data_layer(payload: Column) -> Column:
    """``{"present": ..., "entries": [...]}`` as ``present`` and the raw JSON of each entry; null if it isn't that."""
    v = F.try_parse_json(payload)
    entries = F.try_variant_get(v, "$.entries", "array<variant>")
    return F.when(
        F.try_variant_get(v, "$.present", "boolean").isNotNull(),
        F.struct(F.try_variant_get(v, "$.present", "boolean").alias("present"), F.transform(entries, lambda e: F.to_json(e)).alias("entries")),
    )


@F.pandas_udf(LongType())
def fnv64(hosts: pd.Series) -> pd.Series:
    """The 64-bit FNV-1a hash, as a signed number; each distinct value is hashed once."""
    known = {}
    for h in hosts.dropna().unique():
        x = 0xCBF29CE484222325
        for b in h.encode():
            x = (x ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        known[h] = x - (1 << 64) if x >> 63 else x
    return hosts.map(known).astype("Int64")


def pick(hosts: Column, n: int) -> Column:
    """The unsigned hash modulo ``n``, from 0."""
    h = fnv64(hosts)
    half = F.shiftrightunsigned(h, 1)  # an unsigned number is twice its half and its last bit
    return F.pmod(F.pmod(half, F.lit(n)) * 2 + h.bitwiseAND(F.lit(1)), F.lit(n))
