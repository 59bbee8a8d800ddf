"""Stable keys, fractions and delays from SHA-256, and small text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_digest(value: Column) -> Column:
    return F.sha2(value, 256)


def short_digest(*parts: Column, size: int = 12) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, size)


def stable_accept(text: Column, modulus: int) -> Column:
    """Whether the first 32 bits of the text's digest are a multiple of the modulus: the offline oracle."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % modulus == 0


def stable_fraction(text: Column) -> Column:
    """The first 64 bits of the digest as a fraction of 2**64."""
    high, low = (F.conv(F.substring(F.sha2(text, 256), a, 8), 16, 10).cast("double") for a in (1, 9))
    return (high * 4294967296.0 + low) / 18446744073709551616.0


def retry_delay(key: Column, retry: Column, seed: Column | None = None) -> Column:
    """0.5 s doubled with each retry up to 8 s, and up to a quarter more by the key."""
    base = F.lit(0.5) * F.pow(F.lit(2.0), F.least(retry - 1, F.lit(4)))
    material = F.concat_ws(":", F.coalesce(seed if seed is not None else F.lit(None).cast("long"), F.lit(0)).cast("string"), key, retry.cast("string"))
    return base * (F.lit(1.0) + F.lit(0.25) * stable_fraction(material))


def failure_tolerance(total: Column, floor: Column | None = None) -> Column:
    return F.greatest(F.coalesce(floor, F.lit(5)) if floor is not None else F.lit(5), F.floor(total * F.lit(0.05)).cast("long"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, 1 at least; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 4))).cast("long")


def duration(seconds: Column) -> Column:
    """1h 2m 3s, 2m 3s or 3.0s."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    return F.when(whole >= 3600, F.format_string("%dh %dm %ds", h, m, s)).when(whole >= 60, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%.1fs", seconds))


def masked(secret: Column) -> Column:
    """First and last four characters of a longer secret."""
    return F.when(F.length(secret) <= 8, F.repeat(F.lit("*"), F.length(secret))).otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.right(secret, F.lit(4))))


def job_id(*parts: Column, digest: Column) -> Column:
    """Parts joined by --, cut so that with a dash and 8 digits of the digest it has 96 characters at most."""
    text = F.regexp_replace(F.substring(F.concat_ws("--", *parts), 1, 87), "-+$", "")
    return F.concat(text, F.lit("-"), F.substring(digest, 1, 8))


def example_pairs(k: Column, bidirectional: bool) -> Column:
    return F.ceil(k / 2) if bidirectional else k


def normalised_names(names: Column) -> Column:
    """Names in lower case with single blanks, distinct and sorted, without empty ones."""
    clean = F.transform(names, lambda n: F.lower(F.trim(F.regexp_replace(n, r"\s+", " "))))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda n: n != "")))
