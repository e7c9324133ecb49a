"""Deterministic splits and samples from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import collapsed


def _first_64_bits(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def bucket_64(text: Column, buckets: int = 100) -> Column:
    """The first eight bytes of the SHA-256, big-endian, modulo ``buckets``."""
    return (_first_64_bits(text) % F.lit(buckets)).cast("int")


def bucket_256(text: Column, buckets: int = 100) -> Column:
    """The whole SHA-256 as one number modulo ``buckets``, by Horner's rule over its eight words.

    The digest is the one element of a list that is mapped, so that it is computed once a row and not once a word.
    """
    step = (1 << 32) % buckets

    def reduced(hexes: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for i in range(8):
            out = (out * step + F.conv(F.substring(hexes, i * 8 + 1, 8), 16, 10).cast("bigint")) % buckets
        return out.cast("int")

    return F.get(F.transform(F.array(F.sha2(text, 256)), reduced), 0)


def split_80_10_10(key: Column) -> Column:
    """``train`` for buckets 0-79, ``val`` for 80-89, else ``test``."""
    b = bucket_64(key)
    return F.when(b < 80, "train").when(b < 90, "val").otherwise("test")


def split_90_5_5(text: Column) -> Column:
    """``train`` for buckets 0-89 of the collapsed text, ``val`` for 90-94, else ``test``."""
    return F.get(F.transform(F.array(bucket_256(collapsed(text))), split_of_bucket), 0)


def split_of_bucket(bucket: Column) -> Column:
    """``train`` for 0-89, ``val`` for 90-94, else ``test``."""
    return F.when(bucket < 90, "train").when(bucket < 95, "val").otherwise("test")


def sample_value(key: Column, seed: str) -> Column:
    """A number in [0, 1) from seed and key; a row is sampled if it is below the rate."""
    return _first_64_bits(F.concat(F.lit(f"{seed}:"), key)).cast("double") / F.lit(float(1 << 64))


def first_by_hash(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The ``n`` rows whose seeded digest of ``key`` is smallest: a sample of fixed size that any run repeats."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)
