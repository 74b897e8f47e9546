"""Hashes of artifacts' sections, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def section_hash(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def audit(sections: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, payload) with each payload's SHA-256."""
    return sections.select(*keys, "section", "payload", section_hash(F.col("payload")).alias("sha256"))


def verify(payloads: DataFrame, hashes: DataFrame, keys: list[str]) -> DataFrame:
    """What is wrong per section: a hash that does not match, one that is missing, or one without a section; null if nothing is."""
    p = payloads.select(*keys, "section", section_hash(F.col("payload")).alias("actual"))
    both = p.join(hashes.select(*keys, "section", F.col("sha256").alias("stored")), [*keys, "section"], "full_outer")
    reason = F.when(F.col("stored").isNull(), "missing hash").when(F.col("actual").isNull(), "orphan hash").when(F.col("actual") != F.col("stored"), "hash mismatch")
    return both.select(*keys, "section", reason.alias("problem"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs has; none if the runs agree."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))
