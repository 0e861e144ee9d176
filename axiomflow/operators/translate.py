"""Translations between classes, nominals and individuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomflow.operators.dictionary import numbered
from axiomflow.schema import DATATYPE


def nominals_to_assertions(sub: DataFrame, ex: DataFrame, individuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """{a} below C as (individual, class), {a} below some r.{b} as (individual, role, other)."""
    people = individuals.select(F.col("x").alias("a"))
    classes = sub.join(people, "a", "left_semi").select(F.col("a").alias("individual"), F.col("b").alias("class"))
    pairs = ex.join(people, "a", "left_semi").join(individuals.select(F.col("x").alias("b")), "b", "left_semi")
    return classes, pairs.select(F.col("a").alias("individual"), F.col("r").alias("role"), F.col("b").alias("other"))


def individuals_to_classes(classes: DataFrame, pairs: DataFrame, prefix: str = "C") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A generated class for each individual: (individual, class_name), subclass axioms (a, b), existentials (a, r, b)."""
    named = classes.select("individual").unionByName(pairs.select("individual")).unionByName(pairs.select(F.col("other").alias("individual"))).distinct()
    names = numbered(named, "individual", 1, "n").select("individual", F.concat(F.lit(prefix), F.col("n").cast("string")).alias("class_name"))
    sub = classes.join(names, "individual").select(F.col("class_name").alias("a"), F.col("class").alias("b"))
    other = names.select(F.col("individual").alias("other"), F.col("class_name").alias("b"))
    ex = pairs.join(names, "individual").join(other, "other").select(F.col("class_name").alias("a"), F.col("role").alias("r"), "b")
    return names, sub, ex


def expand_nominals(rows: DataFrame, left: str = "individuals", right: str = "b") -> DataFrame:
    """One axiom (a, b) for each individual of a set on the left."""
    return rows.select(F.explode(left).alias("a"), F.col(right).alias("b")).distinct()


def single_nominals(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose set of individuals has one member."""
    return rows.filter(F.size(column) == 1)


def with_ranges(ex: DataFrame, rng: DataFrame) -> DataFrame:
    """(r, n): existential axioms on the right whose role has a range."""
    return ex.join(rng.select("r").distinct(), "r", "left_semi").groupBy("r").agg(F.count(F.lit(1)).alias("n"))


def datatype_seeds(dictionary: DataFrame) -> DataFrame:
    """Each datatype is below itself."""
    return dictionary.filter(F.col("kind") == DATATYPE).select(F.col("id").alias("x"), F.col("id").alias("b"))
