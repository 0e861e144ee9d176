"""Set commands over keyed sets: tables (key, member, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*facts: DataFrame) -> DataFrame:
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f)
    return out.distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def insert_new(known: DataFrame, more: DataFrame, keys: list[str], round_no: int) -> DataFrame:
    """Rows of ``more`` that aren't known by their keys, once each, stamped with a round."""
    return more.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti").withColumn("round", F.lit(round_no))


def by_score(facts: DataFrame, low, high, score: str = "round") -> DataFrame:
    """Members whose score lies between two bounds, both included."""
    return facts.filter(F.col(score).between(low, high))


def members(facts: DataFrame, key, key_col: str = "b") -> DataFrame:
    return facts.filter(F.col(key_col) == F.lit(key))


def contained(facts: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """asked with ``found``: whether a fact with the keys exists."""
    known = facts.select(*keys).distinct().withColumn("found", F.lit(True))
    return asked.join(known, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def by_rank(facts: DataFrame, k: int, *order) -> DataFrame:
    """The first k members in an order."""
    return facts.orderBy(*order).limit(k)


def top_score(facts: DataFrame, key: str, score: str = "round") -> DataFrame:
    return facts.groupBy(key).agg(F.max(score).alias("top_score"))


def union_store(facts: DataFrame, keys: DataFrame, key_col: str, member_col: str, to: str) -> DataFrame:
    """(key, member): the union of the sets of some keys under a new key."""
    found = facts.join(keys.select(key_col), key_col, "left_semi").select(F.lit(to).alias(key_col), member_col)
    return found.distinct()
