"""Deterministic hashes for splits, shuffles, payload checks and entity tags, as Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own domain tag of weighted splits; pass another system's tag to get its buckets.
SPLIT_DOMAIN = b"weighted-split-v1\0"


def split_bucket(sample_id: Column, seed: int, total: int, domain: bytes = SPLIT_DOMAIN) -> Column:
    """floor(u64 * total / 2**64) of the first 8 bytes of sha256(domain, seed, length, id), integers big-endian."""
    length = F.unhex(F.lpad(F.hex(F.octet_length(sample_id)), 8, "0"))
    digest = F.sha2(F.concat(F.lit(domain + seed.to_bytes(8, "big")), length, sample_id), 256)
    value = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    scaled = (value * F.lit(total).cast("decimal(10,0)")).cast("decimal(38,0)")
    unit = F.lit(str(2**64)).cast("decimal(20,0)")
    return ((scaled - F.pmod(scaled, unit)) / unit).cast("long")


def global_shuffle_key(sample_id: Column, seed: int, epoch: int, plan: bytes) -> Column:
    """md5(seed, epoch, plan, id), integers little-endian: the order of a seeded shuffle of everything."""
    return F.md5(F.concat(F.lit(seed.to_bytes(8, "little") + epoch.to_bytes(8, "little") + plan), sample_id))


def group_shuffle_key(sample_id: Column, seed: int, snapshot: bytes) -> Column:
    """md5(seed, snapshot, id): the order within a shuffle group."""
    return F.md5(F.concat(F.lit(seed.to_bytes(8, "little") + snapshot), sample_id))


def verified(payload: Column, md5: Column, length: Column) -> Column:
    """Whether a payload has the length and digest on record."""
    return F.coalesce((F.md5(payload) == md5) & (F.octet_length(payload) == length), F.lit(False))


def etag(payload: Column) -> Column:
    return F.md5(payload)


def multipart_etag(part_etags: Column) -> Column:
    """md5 of the parts' digests, then the number of parts."""
    joined = F.unhex(F.array_join(part_etags, ""))
    return F.concat_ws("-", F.md5(joined), F.size(part_etags).cast("string"))


def slot(key: Column, slots: int):
    """xxh64 (seed 0) of binary keys, masked to a power of two of slots; Arrow batches, for Spark's own hash has another seed."""
    if slots & (slots - 1) or slots <= 0:
        raise ValueError("slots must be a power of two")

    @F.pandas_udf("long")
    def of(keys: pd.Series) -> pd.Series:
        import xxhash

        return keys.map(lambda k: xxhash.xxh64_intdigest(bytes(k)) & (slots - 1), na_action="ignore")

    return of(key)
