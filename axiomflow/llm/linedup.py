"""Removal of repeated passages by overlapping windows of three lines, in DataFrame functions only.

Each three consecutive lines that are not blank make a window. A window found more than once anywhere is kept where
it comes first, by document and place; the lines that its later occurrences cover are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomflow.llm.common import materialised, prepare

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _places(lines: Column) -> Column:
    """Indices of the lines that hold more than white space."""
    return F.filter(F.transform(lines, lambda s, i: F.when(s.rlike(r"[^ \t\r\x0b\x0c]"), i)), lambda i: i.isNotNull())


def _windows(lines: Column, places: Column) -> Column:
    """(two 64-bit hashes, number of the first line among those not blank) of each window."""
    n = F.size(places)

    def window(k: Column) -> Column:
        three = [F.element_at(lines, F.element_at(places, k + i) + 1) for i in range(1, WIDTH + 1)]
        return F.struct(F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(WIDTH), *reversed(three)).alias("h2"), k.alias("k"))

    return F.when(n >= WIDTH, F.transform(F.sequence(F.lit(0), n - WIDTH), window)).otherwise(F.array())


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare_first: bool = True) -> DataFrame:
    """Adds ``n_lines``, ``n_removed`` and ``dedup_text``; all rows stay.

    The order of documents is that of ``id_col`` (null first), then of the hash of the text; rows with equal id and
    text are one document and get the same result. Blank lines make no window and stay. Lines of the kept occurrence
    of a repeated window stay even if a later occurrence overlaps them; with ``spare_first`` off they go like all lines that
    a later occurrence covers, and each such passage is still left where it comes first. Documents of fewer than three lines that
    aren't blank stay whole; a null text gives an empty one. Columns of the added names are replaced.
    """
    prepare(df.sparkSession)
    added = ["n_lines", "n_removed", "dedup_text"]
    passed = [c for c in df.columns if c not in added]
    text = F.col(f"`{text_col}`").cast("string")
    doc, body = F.col(f"`{id_col}`").alias("__ld_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__ld_hash")
    split = df.select(doc, body, _lines(text).alias("l")).select("__ld_id", "__ld_hash", "l", _places(F.col("l")).alias("p")).filter(F.size("p") >= WIDTH)
    found = split.select("__ld_id", "__ld_hash", F.explode(_windows(F.col("l"), F.col("p"))).alias("w")).select("__ld_id", "__ld_hash", "w.h1", "w.h2", "w.k")
    found = materialised(found, "line-windows")
    spot = F.struct("__ld_id", "__ld_hash", "k")
    again = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("first")).filter("n > 1").select("h1", "h2", "first")
    hits = found.join(again, ["h1", "h2"]).select("__ld_id", "__ld_hash", "k", spot.eqNullSafe(F.col("first")).alias("is_first"))
    covered = hits.groupBy("__ld_id", "__ld_hash").agg(F.collect_set(F.when(~F.col("is_first"), F.col("k"))).alias("__ld_later"), F.collect_set(F.when(F.col("is_first"), F.col("k"))).alias("__ld_kept"))
    covered = covered.filter(F.size("__ld_later") > 0).withColumnsRenamed({"__ld_id": "__ld_id2", "__ld_hash": "__ld_hash2"})
    work = df.select(*[F.col(f"`{c}`") for c in passed], doc, body)
    joined = work.join(covered, work["__ld_id"].eqNullSafe(covered["__ld_id2"]) & (work["__ld_hash"] == covered["__ld_hash2"]), "left")

    def cover(starts: Column) -> Column:
        return F.flatten(F.transform(starts, lambda k: F.array(*[F.element_at("__ld_p", k + i) for i in range(1, WIDTH + 1)])))

    later = cover(F.col("__ld_later"))
    later = F.array_except(later, cover(F.col("__ld_kept"))) if spare_first else F.array_distinct(later)
    gone = F.when(F.col("__ld_later").isNotNull(), later).otherwise(F.array().cast("array<int>"))
    cut = joined.withColumn("__ld_l", _lines(text)).withColumn("__ld_p", F.when(F.col("__ld_later").isNotNull(), _places(F.col("__ld_l")))).withColumn("__ld_gone", gone)
    stay = F.array_except(F.sequence(F.lit(0), F.size("__ld_l") - 1), F.col("__ld_gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.element_at("__ld_l", i + 1)), "\n")
    new = F.when(F.size("__ld_gone") > 0, rest).otherwise(F.coalesce(text, F.lit("")))
    return cut.select(*[F.col(f"`{c}`") for c in passed], F.size("__ld_l").cast("bigint").alias("n_lines"), F.size("__ld_gone").cast("bigint").alias("n_removed"), new.alias("dedup_text"))
