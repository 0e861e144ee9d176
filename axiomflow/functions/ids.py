"""Packed identifiers and other column functions that the engine's file formats need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_id(entity_id: Column, kind: Column) -> Column:
    """Two digits of length, the decimal id, one digit of kind: 12 of kind 0 is 02120. Packed ids may be joined."""
    digits = entity_id.cast("string")
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), digits, kind.cast("string"))


def unpack_id(packed: Column) -> Column:
    """(id, kind) of one packed id."""
    n = F.substring(packed, 1, 2).cast("int")
    return F.struct(F.substring(packed, F.lit(3), n).cast("bigint").alias("id"), F.substring(packed, n + 3, F.lit(1)).cast("int").alias("kind"))


def unpack_ids(packed: Column) -> Column:
    """Array of (id, kind) of packed ids joined without separators."""
    start = F.struct(packed.alias("rest"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, _: Column) -> Column:
        n = F.substring(acc["rest"], 1, 2).cast("int") + 3
        more = F.length(acc["rest"]) > 3
        return F.when(more, F.struct(F.substring(acc["rest"], n + F.lit(1), F.length(acc["rest"])).alias("rest"), F.concat(acc["done"], F.array(F.substring(acc["rest"], F.lit(1), n))).alias("done"))).otherwise(acc)

    # four characters are the least that a packed id can have
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(packed) / 4, F.lit(1)).cast("int")), start, step, lambda acc: F.transform(acc["done"], unpack_id))


def strip_iri(text: Column) -> Column:
    """An IRI without its enclosing angle brackets."""
    return F.regexp_replace(text, r"^<(.*)>$", "$1")


def local_name(iri: Column) -> Column:
    return F.regexp_extract(iri, r"([^#/:]*)$", 1)


def clock_seconds(text: Column) -> Column:
    """Seconds of a time written as 2m3.456s."""
    return F.regexp_extract(text, r"(\d+)m", 1).try_cast("double") * 60 + F.regexp_extract(text, r"m([\d.]+)s", 1).try_cast("double")


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key by Murmur3 hash."""
    return F.pmod(F.hash(key), F.lit(shards))
