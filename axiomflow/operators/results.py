"""Shaping, comparing and exporting closures. Facts are (x, b): x is below b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomflow.schema import BOTTOM, TOP


def transpose(s: DataFrame, separator: str = ",") -> DataFrame:
    """(x, supers, n): all that x is below, sorted and joined."""
    return s.groupBy("x").agg(F.array_join(F.sort_array(F.collect_set("b")), separator).alias("supers"), F.count_distinct("b").alias("n"))


def instances(s: DataFrame, individuals: DataFrame, separator: str = ",") -> DataFrame:
    """(b, instances, n): individuals below each class, the class itself left out."""
    found = s.join(individuals.select("x"), "x", "left_semi").filter("x != b")
    return found.groupBy("b").agg(F.array_join(F.sort_array(F.collect_set("x")), separator).alias("instances"), F.count_distinct("x").alias("n"))


def equivalents(s: DataFrame) -> DataFrame:
    """(x, y), x < y, each below the other."""
    return s.filter("x < b").select("x", F.col("b").alias("y")).intersect(s.filter("x > b").select(F.col("b").alias("x"), F.col("x").alias("y")))


def unsatisfiable(s: DataFrame, nothing=BOTTOM) -> DataFrame:
    return s.filter((F.col("b") == F.lit(nothing)) & (F.col("x") != F.lit(nothing))).select("x").distinct()


def direct_supers(s: DataFrame) -> DataFrame:
    """(x, b) with nothing strictly between. Classes that are equivalent to x or b are not between."""
    strict = s.filter("x != b").join(s.select(F.col("b").alias("x"), F.col("x").alias("b")), ["x", "b"], "left_anti")
    upper = strict.select(F.col("x").alias("m"), F.col("b").alias("top"))
    between = strict.join(upper, F.col("b") == F.col("m")).select("x", F.col("top").alias("b"))
    return strict.join(between, ["x", "b"], "left_anti").distinct()


def expected(strict: DataFrame, equivalent: DataFrame, classes: DataFrame, top=TOP) -> DataFrame:
    """What a complete answer holds: strict supers, the class itself, top, and its equivalents (x, y)."""
    own = classes.select("x", F.col("x").alias("b")).unionByName(classes.select("x", F.lit(top).alias("b")))
    both = equivalent.select("x", F.col("y").alias("b")).unionByName(equivalent.select(F.col("y").alias("x"), F.col("x").alias("b")))
    return strict.select("x", "b").unionByName(own).unionByName(both).distinct()


def missing(s: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("x", "b").distinct().join(s.select("x", "b"), ["x", "b"], "left_anti")


def extra(s: DataFrame, wanted: DataFrame) -> DataFrame:
    return missing(wanted, s)


def compare(s: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, n_found, n_wanted, n_missing, n_extra) of classes on which the two differ."""
    a, b = s.select("x", "b").distinct().withColumn("f", F.lit(1)), wanted.select("x", "b").distinct().withColumn("w", F.lit(1))
    both = a.join(b, ["x", "b"], "full_outer").groupBy("x").agg(F.count("f").alias("n_found"), F.count("w").alias("n_wanted"), F.count_if(F.col("f").isNull()).alias("n_missing"), F.count_if(F.col("w").isNull()).alias("n_extra"))
    return both.filter("n_missing + n_extra > 0")


def completeness(s: DataFrame, wanted: DataFrame) -> DataFrame:
    """(n_classes, percent): mean over classes of the share of wanted supers that were found."""
    hit = wanted.select("x", "b").distinct().join(s.select("x", "b").distinct().withColumn("f", F.lit(1.0)), ["x", "b"], "left")
    each = hit.groupBy("x").agg(F.avg(F.coalesce("f", F.lit(0.0))).alias("share"))
    return each.agg(F.count(F.lit(1)).alias("n_classes"), F.round(100 * F.avg("share"), 6).alias("percent"))


def pair_lines(s: DataFrame, separator: str = "|") -> DataFrame:
    """(value): one line "x|b" for each fact."""
    return s.select(F.concat_ws(separator, F.col("x").cast("string"), F.col("b").cast("string")).alias("value"))


def diff_lines(s: DataFrame, wanted: DataFrame) -> DataFrame:
    """(value): lines of a difference report, "- x|b" for missing facts and "+ x|b" for extra ones."""
    lost = pair_lines(missing(s, wanted)).select(F.concat(F.lit("- "), "value").alias("value"))
    return lost.unionByName(pair_lines(extra(s, wanted)).select(F.concat(F.lit("+ "), "value").alias("value")))


def side_by_side(s: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, found, wanted): both answers for each class, in one row."""
    a = transpose(s).select("x", F.col("supers").alias("found"))
    b = transpose(wanted).select("x", F.col("supers").alias("wanted"))
    return a.join(b, "x", "full_outer")


def role_values(r: DataFrame, role) -> DataFrame:
    """(x, y) of one role."""
    return r.filter(F.col("r") == F.lit(role)).select("x", "y")


def compare_instances(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(b, n_found, n_wanted, n_missing, n_extra) of classes whose sets of instances x differ between two relations (x, b)."""
    turned = lambda df: df.select(F.col("b").alias("x"), F.col("x").alias("b"))
    return compare(turned(found), turned(wanted)).withColumnRenamed("x", "b")
