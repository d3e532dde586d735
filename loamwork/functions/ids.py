"""Identity: content-addressed ids, repository ids, file keys, splits by hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """prefix and the first hex digits of the SHA-256 of the parts, joined by the unit separator; null is 'None'."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *texts), 256), 1, length))


def unit_hash(*parts: Column) -> Column:
    """A number from 0 to 1 from the first 64 bits of the SHA-256 of the parts, joined by colons."""
    hexed = F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)
    return F.conv(hexed, 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def hash_split(group: Column, seed: str, train: float = 0.70, dev: float = 0.85) -> Column:
    """train, dev or test by the group's hash, so a group is never divided."""
    at = unit_hash(F.lit(seed), group.cast("string"))
    return F.when(at < train, "train").when(at < dev, "dev").otherwise("test")


def file_key(path: Column) -> Column:
    """Last component of a path with either slash, lower-case."""
    return F.lower(F.element_at(F.split(F.coalesce(path, F.lit("")), r"[/\\]"), -1))


def logical_id(path: Column) -> Column:
    """Repository record id that a file name starts with: prefix_id, or ou_ and leading digits."""
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce(path, F.lit("")), r"[/\\]"), -1), r"\.[^.]*$", "")
    named = F.regexp_extract(stem, r"^([A-Za-z][A-Za-z0-9-]*)_([^_]+)", 1)
    numbered = F.regexp_extract(stem, r"^([0-9]+)", 1)
    return (
        F.when(named != "", F.concat(F.lower(named), F.lit("_"), F.regexp_extract(stem, r"^([A-Za-z][A-Za-z0-9-]*)_([^_]+)", 2)))
        .when(numbered != "", F.concat(F.lit("ou_"), numbered))
    )
