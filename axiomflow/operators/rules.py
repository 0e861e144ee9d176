"""Completion rules as joins.

Facts: S (x, b): x is subsumed by b. R (r, x, y): x has an r-successor y. Each rule takes deltas and full tables (which
hold the deltas) and returns candidate facts, repeated or known ones included. Axiom tables come in as they should
be joined, with a broadcast hint if they are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facts_s(x: Column, b: Column) -> list[Column]:
    return [x.alias("x"), b.alias("b")]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sub(ds: DataFrame, ax_sub: DataFrame) -> DataFrame:
    """a is below b: what is below a is below b."""
    ax = ax_sub.select(F.col("a").alias("k"), F.col("b").alias("to"))
    return ds.join(ax, ds["b"] == ax["k"]).select("x", F.col("to").alias("b"))


def conj(ds: DataFrame, s: DataFrame, ax_conj: DataFrame) -> DataFrame:
    """What is below all operands is below b. Only conjunctions that a new fact touches are looked at."""
    ax = ax_conj.select("conj_id", "operand", "arity", F.col("b").alias("to"))
    touched = ds.join(ax, ds["b"] == ax["operand"]).select("x", "conj_id").distinct()
    wanted = touched.join(ax, "conj_id")
    full = s.join(ax.select(F.col("operand").alias("b")), "b", "left_semi").select(F.col("x").alias("sx"), F.col("b").alias("sb"))
    held = wanted.join(full, (F.col("x") == F.col("sx")) & (F.col("operand") == F.col("sb")), "left_semi")
    return held.groupBy("x", "conj_id", "arity", "to").agg(F.count_distinct("operand").alias("n")).filter("n = arity").select("x", F.col("to").alias("b"))


def conj_binary(ds: DataFrame, s: DataFrame, ax_conj: DataFrame) -> DataFrame:
    """Conjunctions of two operands by one join for each side of the new fact."""
    two = ax_conj.filter("arity = 2").groupBy("conj_id", "b").agg(F.min("operand").alias("p"), F.max("operand").alias("q"))
    sides = union([two.select(F.col("p").alias("k"), F.col("q").alias("other"), F.col("b").alias("to")), two.select(F.col("q").alias("k"), F.col("p").alias("other"), F.col("b").alias("to"))])
    half = ds.join(sides, ds["b"] == sides["k"]).select("x", "other", "to").distinct()
    full = s.select(F.col("x").alias("sx"), F.col("b").alias("sb"))
    return half.join(full, (F.col("x") == F.col("sx")) & (F.col("other") == F.col("sb")), "left_semi").select("x", F.col("to").alias("b"))


def ex_right(ds: DataFrame, ax_ex: DataFrame) -> DataFrame:
    """a is below some r.b: what is below a has an r-successor b."""
    ax = ax_ex.select(F.col("a").alias("k"), "r", F.col("b").alias("y"))
    return ds.join(ax, ds["b"] == ax["k"]).select("r", "x", "y")


def ex_left_part(ds: DataFrame, ax_exl: DataFrame) -> DataFrame:
    """Q (r, y, b): an r-predecessor of y is below b."""
    ax = ax_exl.select("r", F.col("a").alias("k"), F.col("b").alias("to"))
    return ds.join(ax, ds["b"] == ax["k"]).select("r", F.col("x").alias("y"), F.col("to").alias("b")).distinct()


def ex_left(q: DataFrame, r: DataFrame) -> DataFrame:
    """Q and R meet on role and successor."""
    return r.join(q, ["r", "y"]).select("x", "b")


def ex_left_delta(ds: DataFrame, s: DataFrame, dr: DataFrame, r: DataFrame, ax_exl: DataFrame) -> DataFrame:
    """New Q with all of R, and all of Q with new R. The full Q is restricted to roles and successors of new R."""
    used = ax_exl.select("r").distinct()
    new = dr.join(used, "r", "left_semi")
    near = s.join(new.select(F.col("y").alias("x")).distinct(), "x", "left_semi")
    return union([ex_left(ex_left_part(ds, ax_exl), r), ex_left(ex_left_part(near, ax_exl), new)])


def role_super(r: DataFrame, role_closure: DataFrame) -> DataFrame:
    """Each pair under all roles above its role, itself included: pairs of roles outside the closure stay."""
    ax = role_closure.select(F.col("r").alias("k"), F.col("s").alias("up"))
    above = r.join(ax, r["r"] == ax["k"]).select(F.col("up").alias("r"), "x", "y")
    return union([r.select("r", "x", "y"), above])


def climb(r: DataFrame, above: DataFrame) -> DataFrame:
    """Each pair under its role and all roles above it (a table of r and the array ups), without a second copy of r in the plan:
    rows stay where they are if the table is broadcast."""
    ups = F.concat(F.array("r"), F.coalesce("ups", F.array().cast("array<string>" if r.schema["r"].dataType.typeName() == "string" else "array<bigint>")))
    return r.join(above, "r", "left").select(F.explode(ups).alias("r"), "x", "y")


def chain_legs(first: DataFrame, second: DataFrame, ax_chain: DataFrame) -> DataFrame:
    """t(x, z) of r(x, y) in ``first`` and s(y, z) in ``second`` with r o s below t."""
    ax = ax_chain.select(F.col("r").alias("c1"), F.col("s").alias("c2"), F.col("t").alias("c3"))
    one = first.join(ax, first["r"] == ax["c1"]).select("x", F.col("y").alias("m"), "c2", "c3")
    two = second.select(F.col("r").alias("c2"), F.col("x").alias("m"), F.col("y").alias("z"))
    return one.join(two, ["m", "c2"]).select(F.col("c3").alias("r"), "x", F.col("z").alias("y"))


def chain(dr: DataFrame, r: DataFrame, ax_chain: DataFrame) -> DataFrame:
    """r(x, y), s(y, z), r o s below t: t(x, z). The whole row (r, s, t) is matched."""
    ax = ax_chain.select(F.col("r").alias("c1"), F.col("s").alias("c2"), F.col("t").alias("c3"))
    seconds = ax.select("c2").distinct()

    def legs(first: DataFrame, second: DataFrame) -> DataFrame:
        one = first.join(ax, first["r"] == ax["c1"]).select("x", F.col("y").alias("m"), "c2", "c3")
        two = second.select(F.col("r").alias("c2"), F.col("x").alias("m"), F.col("y").alias("z"))
        two = two.join(seconds, "c2", "left_semi")  # only roles that some chain ends with are moved
        return one.join(two, ["m", "c2"]).select(F.col("c3").alias("r"), "x", F.col("z").alias("y"))

    return union([legs(dr, r), legs(r, dr)])


def bottom(ds: DataFrame, s: DataFrame, dr: DataFrame, r: DataFrame, nothing) -> DataFrame:
    """What has a successor below bottom is below bottom."""
    dead = lambda t: t.filter(F.col("b") == F.lit(nothing)).select(F.col("x").alias("y")).distinct()
    hit = union([r.select("x", "y").join(dead(ds), "y", "left_semi"), dr.select("x", "y").join(dead(s), "y", "left_semi")])
    return hit.select("x", F.lit(nothing).alias("b"))


def domain(dr: DataFrame, ax_dom: DataFrame) -> DataFrame:
    """What has an r-successor is below each domain of r."""
    return dr.join(ax_dom, "r").select("x", F.col("d").alias("b"))


def range_of_individuals(dr: DataFrame, ax_rng: DataFrame, individuals: DataFrame) -> DataFrame:
    """r-successors that are individuals are below each range of r."""
    people = individuals.select(F.col("x").alias("y"))
    return dr.join(ax_rng, "r").join(people, "y", "left_semi").select(F.col("y").alias("x"), F.col("d").alias("b"))
