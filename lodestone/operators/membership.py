"""Approximate membership as a table: a Bloom filter whose bits are spread over rows, so that it grows with the cluster.

A filter is (bucket, bits): 32,768 bits a row. Building it is one aggregation with map-side combine; asking is an equi-join
on the bucket. There are no false negatives; of keys never added about ``p`` are taken for members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import bloom_size

PER_BUCKET = 32_768


def _positions(key: Column, bits: int, hashes: int) -> Column:
    """The key's bit positions, by double hashing."""
    a, b = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * F.pmod(b, F.lit(bits)), F.lit(bits)))


def build_filter(keys: DataFrame, key: str, expected: float, p: float = 1e-4) -> DataFrame:
    """(bucket, bits) of all keys; nulls aren't added."""
    bits, hashes = bloom_size(expected, p)
    at = keys.where(F.col(key).isNotNull()).select(F.explode(_positions(F.col(key), bits, hashes)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / PER_BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(PER_BUCKET))).alias("bits"))


def maybe_members(df: DataFrame, key: str, filter_: DataFrame, expected: float, p: float = 1e-4) -> DataFrame:
    """(key, member) of the distinct keys; a null key is no member. ``expected`` and ``p`` as the filter was built with."""
    bits, hashes = bloom_size(expected, p)
    asked = df.select(key).distinct()
    at = asked.select(key, F.explode(_positions(F.col(key), bits, hashes)).alias("at"))
    spot = at.withColumn("bucket", F.floor(F.col("at") / PER_BUCKET)).join(filter_, "bucket", "left")
    bit = F.pmod("at", F.lit(PER_BUCKET))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    one = F.coalesce(F.expr("shiftright(_byte, cast(pmod(at, 8) as int)) & 1"), F.lit(0))
    tested = spot.withColumn("_byte", byte).groupBy(key).agg(F.min(one).alias("_all"))
    return tested.select(key, (F.col("_all") == 1).alias("member"))
