"""Larger and random ontologies for scaling tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomflow.operators.dictionary import numbered
from axiomflow.schema import BOTTOM, COLUMNS, ENTITY, TOP, Axioms


def _suffixed(column: str, suffix):
    c = F.col(column)
    return F.when(c.isin(TOP, BOTTOM), c).otherwise(F.concat(c, suffix)).alias(column)


def copies(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """n copies of each row, the i-th with "_i" after the named IRIs; top and bottom stay as they are."""
    many = df.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    suffix = F.concat(F.lit("_"), F.col("__i").cast("string"))
    return many.select(*[_suffixed(c, suffix) if c in columns else F.col(c) for c in df.columns])


def multiply(ax: Axioms, n: int) -> Axioms:
    """n disjoint copies of an ontology."""
    tables = {}
    for kind, names in COLUMNS.items():
        df = getattr(ax, kind)
        if kind == "conj":
            many = df.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(n))))
            suffix = F.concat(F.lit("_"), F.col("__i").cast("string"))
            tables[kind] = many.select(F.xxhash64("conj_id", "__i").alias("conj_id"), _suffixed("operand", suffix), "arity", _suffixed("b", suffix))
        else:
            tables[kind] = copies(df, [c for c in names if c in ENTITY], n)
    return Axioms(**tables, individuals=copies(ax.individuals, ["x"], n))


def cross_multiply(sub: DataFrame) -> DataFrame:
    """Two copies of subclass axioms (a, b); in the second the suffixes of classes at odd and even places of the sorted
    signature change over."""
    names = sub.select(F.col("a").alias("iri")).union(sub.select("b")).distinct()
    odd = numbered(names, "iri", 1, "n").select("iri", (F.col("n") % 2).alias("odd"))
    met = sub.join(odd.select(F.col("iri").alias("a"), F.col("odd").alias("oa")), "a").join(odd.select(F.col("iri").alias("b"), F.col("odd").alias("ob")), "b")
    name = lambda c, o, first: F.concat(F.col(c), F.when((F.col(o) == 1) == F.lit(first), "_1").otherwise("_2"))
    return met.select(name("a", "oa", True).alias("a"), name("b", "ob", True).alias("b")).union(met.select(name("a", "oa", False), name("b", "ob", False)))


def merge(*parts: DataFrame) -> DataFrame:
    """All rows of several axiom tables, once each."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def individuals(spark: SparkSession, n: int = 1000, prefix: str = "individual:") -> DataFrame:
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("x"))


def random_assertions(spark: SparkSession, people: int, assertions: int, roles: list[str], classes: int = 1000, class_share: float = 0.7, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Class assertions (individual, class) and property assertions (individual, role, other), by seeded hashes."""
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m))
    who = lambda k: F.concat(F.lit("individual:"), draw(k, people).cast("string"))
    rows = spark.range(assertions).withColumn("kind", draw(0, 1_000_000) < int(class_share * 1_000_000))
    asserted = rows.filter("kind").select(who(1).alias("individual"), F.concat(F.lit("class:"), draw(2, classes).cast("string")).alias("class"))
    role = F.element_at(F.array(*map(F.lit, roles)), (draw(3, len(roles)) + 1).cast("int"))
    return asserted, rows.filter(~F.col("kind")).select(who(1).alias("individual"), role.alias("role"), who(4).alias("other"))
