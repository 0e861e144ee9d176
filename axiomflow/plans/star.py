"""An ontology over the star schema: entities of the tables as classes, foreign keys as roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomflow.operators import rules
from axiomflow.schema import BOTTOM, Axioms

ROLES = [("placedBy", "relatedTo"), ("suppliedBy", "relatedTo"), ("contains", "relatedTo")]
CHAINS = [("placedBy", "inNation", "fromNation"), ("fromNation", "inRegion", "fromRegion"), ("suppliedBy", "inNation", "suppliedFrom")]
LEFT = [("fromRegion", "region:2", "AsianOrder"), ("contains", "HotPart", "HotOrder")]
CONJUNCTIONS = [(("Brand#13", "type:ECONOMY"), "HotPart"), (("AsianOrder", "status:F"), "ClosedAsian"), (("Brand#1", "type:PROMO"), BOTTOM)]
DOMAINS, RANGES = [("placedBy", "SalesDoc")], [("contains", "Item")]


def iri(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) of parts and their brand and type, and of brands and types and Product."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    brand, kind = F.col("p_brand"), iri("type", "p_type")
    return rules.union([
        part.select(iri("part", "p_partkey").alias("a"), brand.alias("b")),
        part.select(iri("part", "p_partkey").alias("a"), kind.alias("b")),
        part.select(brand.alias("a"), F.lit("Product").alias("b")).distinct(),
        part.select(kind.alias("a"), F.lit("Product").alias("b")).distinct(),
    ])


def sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain subclass axioms (a, b)."""
    nation, customer, orders = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return rules.union([
        nation.select(iri("nation", "n_nationkey").alias("a"), iri("region", "n_regionkey").alias("b")),
        part_types(spark, sf_dir),
        customer.select(iri("customer", "c_custkey").alias("a"), iri("segment", "c_mktsegment").alias("b")),
        orders.select(iri("order", "o_orderkey").alias("a"), iri("status", "o_orderstatus").alias("b")),
        orders.select(iri("order", "o_orderkey").alias("a"), iri("priority", "o_orderpriority").alias("b")),
    ])


def existentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, r, b): a is below some r.b, for each foreign key."""
    edge = lambda df, a, r, b: df.select(a.alias("a"), F.lit(r).alias("r"), b.alias("b"))
    line = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    return rules.union([
        edge(read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), iri("order", "o_orderkey"), "placedBy", iri("customer", "o_custkey")),
        edge(read(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), iri("customer", "c_custkey"), "inNation", iri("nation", "c_nationkey")),
        edge(read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), iri("supplier", "s_suppkey"), "inNation", iri("nation", "s_nationkey")),
        edge(read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), iri("nation", "n_nationkey"), "inRegion", iri("region", "n_regionkey")),
        edge(line.select("l_orderkey", "l_partkey").distinct(), iri("order", "l_orderkey"), "contains", iri("part", "l_partkey")),
        edge(line.select("l_orderkey", "l_suppkey").distinct(), iri("order", "l_orderkey"), "suppliedBy", iri("supplier", "l_suppkey")),
        edge(read(spark, sf_dir, "events", "user_id", "event_type").distinct(), iri("user", "user_id"), "did", iri("event", "event_type")),
    ])


def axioms(spark: SparkSession, sf_dir: str) -> Axioms:
    """The whole ontology in normal form, but for its range axiom."""
    fixed = Axioms.from_lists(spark, role=ROLES, chain=CHAINS, exl=LEFT, conj=CONJUNCTIONS, dom=DOMAINS, rng=RANGES)
    return fixed.with_(sub=sub(spark, sf_dir), ex=existentials(spark, sf_dir))
