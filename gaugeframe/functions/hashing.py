"""Deterministic hashing: splits, samples and choices depend on row content and a seed alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hex(namespace: str, seed: int, value: Column) -> Column:
    """SHA-256 of namespace, seed and value joined by NUL, as 64 hex digits; order equals the
    order of the 256-bit integers."""
    return F.sha2(F.concat(F.lit(f"{namespace}\0{seed}\0"), value.cast("string")).cast("binary"), 256)


def hex_to_long(digest: Column, digits: int = 15) -> Column:
    """Leading hex digits as a non-negative bigint."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def unit_interval_split(digest: Column, shares: tuple[float, float] = (0.6, 0.2)) -> Column:
    """train / calibration / test by thresholds on the digest read as a fraction of 2**256.

    The fraction is compared as text with the threshold's 64 hex digits, so no integer is needed.
    """
    first, second = shares[0], shares[0] + shares[1]
    edge = lambda x: format(int(x * (1 << 53)) << 203, "064x")
    return F.when(digest < edge(first), "train").when(digest < edge(second), "calibration").otherwise("test")


def choose_index(digest: Column, n: Column) -> Column:
    """Index of a deterministic choice among n: the first 8 bytes modulo n."""
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % n.cast("decimal(20,0)")).cast("bigint")


def scoped_unit(dataset: Column, group: Column) -> Column:
    return F.concat_ws("::", F.trim(dataset), F.lit("group"), F.trim(group))


def sha256_text(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)
