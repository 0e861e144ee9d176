"""Writers: closures, reports, snapshots, keyed stores, wrapped documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomflow.operators import results
from axiomflow.storage import children, delete

RDF_HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#">\n'
RDF_FOOT = "\n</rdf:RDF>\n"


def write_pairs(s: DataFrame, path: str, separator: str = "|") -> None:
    """Text lines "x|b" of a closure."""
    results.pair_lines(s, separator).write.mode("overwrite").text(path)


def read_pairs(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    parts = F.split("value", f"[{separator}]", 2)
    return spark.read.text(path).select(F.get(parts, 0).alias("x"), F.get(parts, 1).alias("b"))


def write_diff(s: DataFrame, wanted: DataFrame, path: str) -> None:
    results.diff_lines(s, wanted).write.mode("overwrite").text(path)


def write_side_by_side(s: DataFrame, wanted: DataFrame, found_path: str, wanted_path: str) -> None:
    """Both answers, sorted by class, one "x: supers" line for each class, in two folders that can be compared."""
    both = results.side_by_side(s, wanted)
    for column, path in (("found", found_path), ("wanted", wanted_path)):
        both.sort("x").select(F.concat_ws(": ", "x", F.coalesce(column, F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def wrap_documents(docs: DataFrame, text_col: str = "text", head: str = RDF_HEAD, foot: str = RDF_FOOT) -> DataFrame:
    """Documents with a header and a footer around their text."""
    return docs.withColumn(text_col, F.concat(F.lit(head), F.coalesce(text_col, F.lit("")), F.lit(foot)))


def snapshot(facts: DataFrame, path: str, label: str) -> None:
    """A copy of a relation under a label, beside earlier ones."""
    facts.write.mode("overwrite").parquet(f"{path}/snapshot={label}")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class KeyedStore:
    """Sets by key, (key, member, score), in a Parquet folder: appends in batches, reads with filters pushed down.

    Rows lie in versions; appends go to the last one. What rewrites rows (delete, truncate) makes a new version and then
    removes the older ones, so no table is overwritten while it is read.
    """

    SCHEMA = "key string, member string, score double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[str]:
        return [n for n in children(self.spark, self.path) if n.startswith("version=") and children(self.spark, f"{self.path}/{n}")[-1:] and "_SUCCESS" in children(self.spark, f"{self.path}/{n}")]

    def _last(self) -> str:
        return (self._versions() or ["version=00000000"])[-1]

    def append(self, rows: DataFrame) -> None:
        rows.select(F.col("key").cast("string"), F.col("member").cast("string"), F.col("score").cast("double")).write.mode("append").parquet(f"{self.path}/{self._last()}")

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{self._last()}")

    def _replace(self, rows: DataFrame) -> None:
        old = self._versions()
        rows.write.mode("overwrite").parquet(f"{self.path}/version={int(self._last()[8:]) + 1:08}")
        for name in old:
            delete(self.spark, f"{self.path}/{name}")

    def range_by_score(self, key: str, low: float, high: float) -> DataFrame:
        return self.table().filter((F.col("key") == key) & F.col("score").between(low, high))

    def members(self, key: str) -> DataFrame:
        return self.table().filter(F.col("key") == key).select("member").distinct()

    def scores(self, asked: DataFrame) -> DataFrame:
        """asked (key, member) with ``score``: the greatest one of a member in a key's set, null if it isn't there."""
        held = self.table().groupBy("key", "member").agg(F.max("score").alias("score"))
        return asked.select("key", "member").join(held, ["key", "member"], "left")

    def as_map(self, key: str) -> DataFrame:
        """(member, score) of one key, each member once: the set read as a map."""
        return self.table().filter(F.col("key") == key).groupBy("member").agg(F.max("score").alias("score"))

    def truncate(self) -> None:
        self._replace(self.table().limit(0))

    def without(self, pattern: str) -> DataFrame:
        """What stays when keys that match a pattern are deleted."""
        return self.table().filter(~F.col("key").rlike(pattern))

    def delete_keys(self, pattern: str) -> None:
        """Deletes all keys that match a pattern."""
        self._replace(self.without(pattern))

    def remove(self, rows: DataFrame) -> None:
        """Deletes the given (key, member) rows."""
        self._replace(self.table().join(rows.select("key", "member"), ["key", "member"], "left_anti").select("key", "member", "score"))
