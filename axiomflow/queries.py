"""Queries over the driver's tables, one or more for each operator, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomflow.functions import ids
from axiomflow.operators import dictionary, generate, normalize, profile, results, rules, setops, stats, translate
from axiomflow.plans import normaliser, placement, star
from axiomflow.plans.saturate import extend, facts, role_closure, saturate, subclass_closure
from axiomflow.schema import BOTTOM, Axioms, frame
from axiomflow.sources import owl, sinks
from axiomflow.storage import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SUB = """sub AS (
  SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation
  UNION ALL SELECT 'part:' || p_partkey, p_brand FROM part UNION ALL SELECT 'part:' || p_partkey, 'type:' || p_type FROM part
  UNION ALL SELECT DISTINCT p_brand, 'Product' FROM part UNION ALL SELECT DISTINCT 'type:' || p_type, 'Product' FROM part
  UNION ALL SELECT 'customer:' || c_custkey, 'segment:' || c_mktsegment FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'status:' || o_orderstatus FROM orders UNION ALL SELECT 'order:' || o_orderkey, 'priority:' || o_orderpriority FROM orders)"""
EX = """ex AS (
  SELECT 'order:' || o_orderkey AS a, 'placedBy' AS r, 'customer:' || o_custkey AS b FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'inNation', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'inNation', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'inRegion', 'region:' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'suppliedBy', 'supplier:' || l_suppkey FROM lineitem
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'did', 'event:' || event_type FROM events)"""
CLOSURE = "up(x, b) AS (SELECT DISTINCT a, b FROM sub UNION SELECT up.x, sub.b FROM up JOIN sub ON sub.a = up.b)"
#: The whole saturation by joins of fixed depth, without recursion over roles.
FRESH = "'urn:fresh:class:' || substr(sha256('range|contains|' || b), 1, 32)"
FULL_R = f"""item AS (SELECT DISTINCT b AS part, {FRESH} AS x FROM ex WHERE r = 'contains'),
flat AS (SELECT a AS x, r, b AS y FROM ex WHERE r <> 'contains' UNION ALL SELECT a, 'contains', item.x FROM ex JOIN item ON item.part = ex.b WHERE r = 'contains'),
rel AS (SELECT r, x, y FROM flat UNION SELECT 'relatedTo', x, y FROM flat WHERE r IN ('placedBy', 'suppliedBy', 'contains')
  UNION SELECT 'fromNation', p.x, n.y FROM flat p JOIN flat n ON p.y = n.x WHERE p.r = 'placedBy' AND n.r = 'inNation'
  UNION SELECT 'suppliedFrom', p.x, n.y FROM flat p JOIN flat n ON p.y = n.x WHERE p.r = 'suppliedBy' AND n.r = 'inNation'
  UNION SELECT 'fromRegion', p.x, g.y FROM flat p JOIN flat n ON p.y = n.x JOIN flat g ON n.y = g.x WHERE p.r = 'placedBy' AND n.r = 'inNation' AND g.r = 'inRegion')"""
FULL_S = f"""{FULL_R},
below AS (SELECT x, b FROM up UNION SELECT item.x, up.b FROM item JOIN up ON up.x = item.part UNION SELECT x, part FROM item UNION SELECT x, 'Item' FROM item),
hot AS (SELECT x FROM below WHERE b = 'Brand#13' INTERSECT SELECT x FROM below WHERE b = 'type:ECONOMY'),
dead AS (SELECT x FROM below WHERE b = 'Brand#1' INTERSECT SELECT x FROM below WHERE b = 'type:PROMO'),
asian AS (SELECT x FROM rel WHERE r = 'fromRegion' AND y = 'region:2'),
s AS (SELECT x, b FROM below UNION SELECT x, 'HotPart' FROM hot UNION SELECT rel.x, 'HotOrder' FROM rel JOIN hot ON hot.x = rel.y WHERE r = 'contains'
  UNION SELECT x, 'owl:Nothing' FROM dead UNION SELECT rel.x, 'owl:Nothing' FROM rel JOIN dead ON dead.x = rel.y
  UNION SELECT x, 'AsianOrder' FROM asian UNION SELECT asian.x, 'ClosedAsian' FROM asian JOIN below USING (x) WHERE b = 'status:F'
  UNION SELECT x, 'SalesDoc' FROM rel WHERE r = 'placedBy')"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return frame(spark, list(values), schema)


def pairs(df: DataFrame, x: str = "x", b: str = "b") -> DataFrame:
    return df.select(F.col(x).alias("x"), F.col(b).alias("b"))


# --- dictionary and seeds


@query(f"""WITH {SUB}, {EX}, e AS (SELECT a AS iri, 0 AS kind FROM sub UNION SELECT b, 0 FROM sub UNION SELECT a, 0 FROM ex UNION SELECT b, 0 FROM ex UNION SELECT r, 2 FROM ex
  UNION SELECT unnest(['relatedTo', 'fromNation', 'fromRegion', 'suppliedFrom']), 2 UNION SELECT unnest(['AsianOrder', 'HotPart', 'HotOrder', 'ClosedAsian', 'SalesDoc', 'Item', 'owl:Nothing', 'owl:Thing', 'Brand#13', 'Brand#1', 'type:ECONOMY', 'type:PROMO', 'status:F', 'region:2']), 0)
SELECT kind, count(DISTINCT iri) AS n, true AS dense FROM e GROUP BY kind UNION ALL SELECT -1, count(DISTINCT iri), true FROM e""")
def q_signature_dict(spark, sf_dir):
    """Entities by kind; ids are dense if the greatest is one less than their number."""
    d = dictionary.encode_signature(star.axioms(spark, sf_dir).signature())
    kinds = d.groupBy(F.col("kind").cast("int").alias("kind")).agg(F.count_distinct("id").alias("n")).withColumn("dense", F.lit(True))
    return kinds.unionByName(d.agg(F.lit(-1).alias("kind"), F.count_distinct("id").alias("n"), (F.max("id") + 1 == F.count_distinct("id")).alias("dense")))


@query(f"WITH {SUB}, e AS (SELECT a AS x FROM sub UNION SELECT b FROM sub UNION SELECT unnest(['owl:Nothing', 'owl:Thing'])) SELECT x, x AS b FROM e UNION SELECT x, 'owl:Thing' FROM e")
def q_init_s(spark, sf_dir):
    ax = Axioms.of(spark, sub=star.sub(spark, sf_dir))
    return dictionary.init_s(dictionary.encode_signature(ax.signature()))


@query("SELECT 'part:' || p_partkey AS iri, 0 AS kind, true AS same FROM part")
def q_dict_lookup_round_trip(spark, sf_dir):
    """IRIs to ids and back, with a dictionary that is extended once."""
    part = star.read(spark, sf_dir, "part", "p_partkey").select(star.iri("part", "p_partkey").alias("iri")).withColumn("kind", F.lit(0))
    first = dictionary.encode_signature(part.filter(F.col("iri") < "part:2"))
    both = dictionary.encode_signature(part, first)
    coded = dictionary.lookup(part.withColumn("copy", F.col("iri")), both, ["copy"])
    return dictionary.lookup(coded, both, ["copy"], back=True).select("iri", "kind", (F.col("copy") == F.col("iri")).alias("same"))


@query("SELECT c_custkey AS id, c_custkey % 4 AS kind, lpad(CAST(length(CAST(c_custkey AS VARCHAR)) AS VARCHAR), 2, '0') || c_custkey || (c_custkey % 4) AS packed, c_custkey AS first_id, c_nationkey AS second_id FROM customer")
def q_pack_unpack_ids(spark, sf_dir):
    c = star.read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    packed = c.select("*", ids.pack_id(F.col("c_custkey"), F.col("c_custkey") % 4).alias("packed"), ids.pack_id(F.col("c_nationkey"), F.lit(2)).alias("other"))
    both = ids.unpack_ids(F.concat("packed", "other"))
    one = ids.unpack_id(F.col("packed"))
    return packed.select(one["id"].alias("id"), one["kind"].cast("bigint").alias("kind"), "packed", F.get(both, 0)["id"].alias("first_id"), F.get(both, 1)["id"].cast("int").alias("second_id"))


# --- completion rules


@query(f"WITH RECURSIVE {SUB}, {CLOSURE} SELECT x, b FROM up WHERE x <> b")
def q_hierarchy_closure(spark, sf_dir):
    return subclass_closure(star.sub(spark, sf_dir)).select("x", "b")


@query(f"WITH RECURSIVE {SUB}, lv(x, b, d) AS (SELECT DISTINCT a, b, 1 FROM sub UNION SELECT lv.x, sub.b, d + 1 FROM lv JOIN sub ON sub.a = lv.b), m AS (SELECT x, b, min(d) AS d FROM lv GROUP BY x, b) SELECT d AS depth, count(*) AS n FROM m GROUP BY d")
def q_delta_rounds(spark, sf_dir):
    return subclass_closure(star.sub(spark, sf_dir)).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SUB} SELECT sub.a AS x, 'Region' AS b FROM sub WHERE b LIKE 'region:%'")
def q_subclass_rule(spark, sf_dir):
    ax = star.read(spark, sf_dir, "region", "r_regionkey").select(star.iri("region", "r_regionkey").alias("a"), F.lit("Region").alias("b"))
    return rules.sub(pairs(star.sub(spark, sf_dir), "a"), F.broadcast(ax))


@query("SELECT 'part:' || p_partkey AS x, 'HotPart' AS b FROM part WHERE p_brand = 'Brand#13' AND p_type = 'ECONOMY' UNION ALL SELECT 'part:' || p_partkey, 'owl:Nothing' FROM part WHERE p_brand = 'Brand#1' AND p_type = 'PROMO'")
def q_conj_binary(spark, sf_dir):
    s = pairs(star.part_types(spark, sf_dir), "a")
    ax = Axioms.from_lists(spark, conj=star.CONJUNCTIONS).conj
    return rules.conj_binary(s, s, ax).distinct()


@query("SELECT 'part:' || p_partkey AS x, 'HotProduct' AS b FROM part WHERE p_brand = 'Brand#13' AND p_type = 'ECONOMY'")
def q_conj_nary(spark, sf_dir):
    s = subclass_closure(star.part_types(spark, sf_dir)).select("x", "b")
    ax = Axioms.from_lists(spark, conj=[(("Brand#13", "type:ECONOMY", "Product"), "HotProduct")]).conj
    return rules.conj(s, s, ax)


@query("SELECT 'servedBy' AS r, 'customer:' || c_custkey AS x, 'desk:' || c_mktsegment AS y FROM customer")
def q_exists_rhs(spark, sf_dir):
    s = star.read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(star.iri("customer", "c_custkey").alias("x"), star.iri("segment", "c_mktsegment").alias("b"))
    ax = s.select("b").distinct().select(F.col("b").alias("a"), F.lit("servedBy").alias("r"), F.regexp_replace("b", "segment:", "desk:").alias("b"))
    return rules.ex_right(s, ax)


@query("SELECT 'inNation' AS r, 'nation:' || n_nationkey AS y, 'Asian' AS b FROM nation WHERE n_regionkey = 2")
def q_exists_lhs_part1(spark, sf_dir):
    ax = rows(spark, "r string, a string, b string", ("inNation", "region:2", "Asian"))
    return rules.ex_left_part(pairs(star.sub(spark, sf_dir), "a"), ax)


@query("SELECT 'customer:' || c_custkey AS x, 'Asian' AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'supplier:' || s_suppkey, 'Asian' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def q_exists_lhs(spark, sf_dir):
    ax = rows(spark, "r string, a string, b string", ("inNation", "region:2", "Asian"))
    r = star.existentials(spark, sf_dir).select("r", F.col("a").alias("x"), F.col("b").alias("y"))
    return rules.ex_left(rules.ex_left_part(pairs(star.sub(spark, sf_dir), "a"), ax), r).distinct()


@query("SELECT 'customer:' || c_custkey AS x, 'Asian' AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'supplier:' || s_suppkey, 'Asian' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def q_exists_lhs_delta(spark, sf_dir):
    """The same by the two-sided delta form: pairs of customers are old, those of suppliers new."""
    ax = rows(spark, "r string, a string, b string", ("inNation", "region:2", "Asian"))
    s = pairs(star.sub(spark, sf_dir), "a")
    r = star.existentials(spark, sf_dir).filter("r = 'inNation'").select("r", F.col("a").alias("x"), F.col("b").alias("y"))
    new_r = r.filter(F.col("x").startswith("supplier"))
    return rules.ex_left_delta(s, s, new_r, r, ax).distinct()


@query("""WITH RECURSIVE e(r, s) AS (VALUES ('placedBy', 'relatedTo'), ('suppliedBy', 'relatedTo'), ('contains', 'relatedTo'), ('relatedTo', 'linked'), ('linked', 'connected'), ('connected', 'linked')),
c(r, s) AS (SELECT r, s FROM e UNION SELECT c.r, e.s FROM c JOIN e ON e.r = c.s) SELECT r, s FROM c WHERE r <> s""")
def q_role_closure(spark, sf_dir):
    return role_closure(rows(spark, "r string, s string", *star.ROLES, ("relatedTo", "linked"), ("linked", "connected"), ("connected", "linked")))


@query(f"WITH {EX} SELECT r, a AS x, b AS y FROM ex UNION SELECT 'relatedTo', a, b FROM ex WHERE r IN ('placedBy', 'suppliedBy', 'contains')")
def q_role_hierarchy(spark, sf_dir):
    r = star.existentials(spark, sf_dir).select("r", F.col("a").alias("x"), F.col("b").alias("y"))
    return rules.role_super(r, F.broadcast(role_closure(rows(spark, "r string, s string", *star.ROLES)))).distinct()


@query("SELECT 'fromNation' AS r, 'order:' || o_orderkey AS x, 'nation:' || c_nationkey AS y FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT 'suppliedFrom', 'order:' || l_orderkey, 'nation:' || s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def q_role_chain(spark, sf_dir):
    r = star.existentials(spark, sf_dir).select("r", F.col("a").alias("x"), F.col("b").alias("y"))
    chain = F.broadcast(rows(spark, "r string, s string, t string", *[c for c in star.CHAINS if c[0] != "fromNation"]))
    return rules.chain(r, r, chain).distinct()


@query("SELECT 'order:' || o_orderkey AS x, 'region:' || n_regionkey AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def q_role_chain_nested(spark, sf_dir):
    """A chain of three roles, split into two chains by the normaliser."""
    text = rows(spark, "axiom string", ("SubObjectPropertyOf(ObjectPropertyChain(<placedBy> <inNation> <inRegion>) <fromRegion>)",))
    tables, _ = normalize.normalise(text)
    ex = star.existentials(spark, sf_dir).filter(F.col("r").isin("placedBy", "inNation", "inRegion"))
    return results.role_values(saturate(tables.with_(ex=ex)).r, "fromRegion")


@query("SELECT 'fromNation' AS r, 'order:' || o_orderkey AS x, 'nation:' || c_nationkey AS y FROM orders JOIN customer ON o_custkey = c_custkey")
def q_role_chain_no_mix(spark, sf_dir):
    """Two chains that begin with one role: the second leg decides which super role holds."""
    r = star.existentials(spark, sf_dir).filter(F.col("r").isin("placedBy", "inNation")).select("r", F.col("a").alias("x"), F.col("b").alias("y"))
    return rules.chain(r, r, rows(spark, "r string, s string, t string", ("placedBy", "inNation", "fromNation"), ("placedBy", "bornIn", "wrong"))).distinct()


NEXT = "nx AS (SELECT 'nation:' || n_nationkey AS a, 'nation:' || lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation)"


@query(f"WITH RECURSIVE {NEXT}, c(x, y) AS (SELECT a, b FROM nx WHERE b IS NOT NULL UNION SELECT c.x, nx.b FROM c JOIN nx ON nx.a = c.y WHERE nx.b IS NOT NULL) SELECT x, y FROM c")
def q_transitive_role(spark, sf_dir):
    """A transitive role along the nations of each region."""
    from pyspark.sql.window import Window

    following = F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    nation = star.read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").withColumn("next", following).filter("next IS NOT NULL")
    tables, _ = normalize.normalise(rows(spark, "axiom string", ("TransitiveObjectProperty(<before>)",)))
    ex = nation.select(star.iri("nation", "n_nationkey").alias("a"), F.lit("before").alias("r"), star.iri("nation", "next").alias("b"))
    return results.role_values(saturate(tables.with_(ex=ex)).r, "before")


DEAD = "dead AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' AND p_type = 'PROMO')"


@query(f"WITH {DEAD} SELECT DISTINCT 'order:' || l_orderkey AS x, 'owl:Nothing' AS b FROM lineitem JOIN dead ON l_partkey = p_partkey")
def q_bottom_propagation(spark, sf_dir):
    s = pairs(star.part_types(spark, sf_dir), "a")
    dead = rules.conj(s, s, Axioms.from_lists(spark, conj=[(("Brand#1", "type:PROMO"), BOTTOM)]).conj)
    r = star.existentials(spark, sf_dir).select("r", F.col("a").alias("x"), F.col("b").alias("y"))
    none = r.limit(0)
    return rules.bottom(dead, dead, none, r, BOTTOM).distinct()


@query(f"WITH {DEAD} SELECT 'part:' || p_partkey AS x FROM dead UNION SELECT 'order:' || l_orderkey FROM lineitem JOIN dead ON l_partkey = p_partkey UNION SELECT 'cart:' || l_orderkey FROM lineitem JOIN dead ON l_partkey = p_partkey")
def q_unsat_classes(spark, sf_dir):
    """Disjoint classes, and emptiness along two roles."""
    tables, _ = normalize.normalise(rows(spark, "axiom string", ("DisjointClasses(<Brand#1> <type:PROMO>)",)))
    line = star.read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").distinct()
    ex = line.select(star.iri("order", "l_orderkey").alias("a"), F.lit("contains").alias("r"), star.iri("part", "l_partkey").alias("b"))
    carts = line.select(star.iri("cart", "l_orderkey").alias("a"), F.lit("holds").alias("r"), star.iri("order", "l_orderkey").alias("b")).distinct()
    return results.unsatisfiable(saturate(tables.with_(sub=star.part_types(spark, sf_dir), ex=ex.unionByName(carts))).s)


@query("SELECT 'order:' || o_orderkey AS x, 'SalesDoc' AS b FROM orders")
def q_domain(spark, sf_dir):
    r = star.existentials(spark, sf_dir).select("r", F.col("a").alias("x"), F.col("b").alias("y"))
    return rules.domain(r, rows(spark, "r string, d string", *star.DOMAINS))


@query("SELECT DISTINCT 'supplier:' || l_suppkey AS x, 'Supplier' AS b FROM lineitem")
def q_range_individuals(spark, sf_dir):
    """Ranges of role pairs whose ends are individuals; pairs with classes get none."""
    r = star.existentials(spark, sf_dir).select("r", F.col("a").alias("x"), F.col("b").alias("y"))
    people = star.read(spark, sf_dir, "supplier", "s_suppkey").select(star.iri("supplier", "s_suppkey").alias("x"))
    return rules.range_of_individuals(r, rows(spark, "r string, d string", ("suppliedBy", "Supplier"), ("contains", "Item")), people).distinct()


@query(f"WITH {EX}, i AS (SELECT DISTINCT b, {FRESH} AS x FROM ex WHERE r = 'contains') SELECT x AS a, b FROM i UNION ALL SELECT x, 'Item' FROM i")
def q_range_elim(spark, sf_dir):
    ax = star.axioms(spark, sf_dir).with_(sub=star.sub(spark, sf_dir).limit(0))
    return normalize.eliminate_ranges(ax).sub


@query(f"WITH RECURSIVE {SUB}, {EX}, {CLOSURE}, {FULL_S} SELECT x, b FROM s")
def q_full_saturation_s(spark, sf_dir):
    """All rules over the whole ontology, on encoded ids."""
    known = dictionary.identified(star.axioms(spark, sf_dir))
    closure = saturate(known.axioms, nothing=known.nothing, top=known.top, ready_made=True)
    return known.decode(facts(closure, known.nothing, known.top), ["x", "b"])


@query(f"WITH RECURSIVE {SUB}, {EX}, {FULL_R} SELECT r, x, y FROM rel")
def q_full_saturation_r(spark, sf_dir):
    known = dictionary.identified(star.axioms(spark, sf_dir))
    closure = saturate(known.axioms, nothing=known.nothing, top=known.top, ready_made=True)
    return known.decode(closure.r.select("r", "x", "y"), ["r", "x", "y"])


@query(f"WITH RECURSIVE {SUB}, {EX}, {CLOSURE}, {FULL_S} SELECT b, count(*) AS n FROM s GROUP BY b")
def q_incremental_equals_batch(spark, sf_dir):
    """Roles, chains and line items come as an increment to a saturated base."""
    known = dictionary.identified(star.axioms(spark, sf_dir))
    ax, ends = known.axioms, {"nothing": known.nothing, "top": known.top}
    line = F.col("r").isin(*known.ids(["contains", "suppliedBy"]))
    none = lambda df: df.limit(0)
    base = ax.with_(ex=ax.ex.filter(~line), role=none(ax.role), chain=none(ax.chain), conj=none(ax.conj))
    more = Axioms.of(spark, "bigint", ex=ax.ex.filter(line), role=ax.role, chain=ax.chain, conj=ax.conj)
    closure = extend(saturate(base, ready_made=True, **ends), more, ready_made=True, **ends)
    return known.decode(facts(closure, **ends).groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["b"])


# --- results


@query(f"WITH RECURSIVE {SUB}, {CLOSURE} SELECT x, string_agg(b, ',' ORDER BY b) AS supers, count(*) AS n FROM up GROUP BY x")
def q_transpose_supers(spark, sf_dir):
    return results.transpose(subclass_closure(star.sub(spark, sf_dir)))


@query("SELECT 'segment:' || c_mktsegment AS b, string_agg('customer:' || c_custkey, ',' ORDER BY 'customer:' || c_custkey) AS instances, count(*) AS n FROM customer GROUP BY c_mktsegment")
def q_instances_of(spark, sf_dir):
    people = star.read(spark, sf_dir, "customer", "c_custkey").select(star.iri("customer", "c_custkey").alias("x"))
    return results.instances(subclass_closure(star.sub(spark, sf_dir)), people)


@query("SELECT 'region:' || r_regionkey AS x, 'zone:' || r_regionkey AS y FROM region")
def q_equivalents(spark, sf_dir):
    """Equivalent classes from axiom texts."""
    text = star.read(spark, sf_dir, "region", "r_regionkey").select(F.format_string("EquivalentClasses(<region:%s> <zone:%s>)", F.col("r_regionkey").cast("string"), F.col("r_regionkey").cast("string")).alias("axiom"))
    tables, _ = normalize.normalise(text)
    return results.equivalents(saturate(tables.with_(sub=tables.sub.unionByName(star.sub(spark, sf_dir)))).s.select("x", "b"))


@query(f"WITH RECURSIVE {SUB}, {CLOSURE} SELECT x, b FROM up WHERE NOT EXISTS (SELECT 1 FROM up p JOIN up q ON p.b = q.x WHERE p.x = up.x AND q.b = up.b)")
def q_direct_supers(spark, sf_dir):
    return results.direct_supers(subclass_closure(star.sub(spark, sf_dir)).select("x", "b"))


@query(f"WITH RECURSIVE {SUB}, {CLOSURE} SELECT x, b FROM up EXCEPT SELECT a, b FROM sub")
def q_compare_missing(spark, sf_dir):
    sub = star.sub(spark, sf_dir)
    return results.missing(pairs(sub, "a"), subclass_closure(sub))


@query(f"WITH {SUB} SELECT DISTINCT a AS x, b FROM sub WHERE b LIKE 'priority:%'")
def q_compare_extra(spark, sf_dir):
    found = pairs(star.sub(spark, sf_dir), "a")
    return results.extra(found, found.filter(~F.col("b").startswith("priority:")))


@query(f"WITH RECURSIVE {SUB}, {CLOSURE}, f AS (SELECT DISTINCT a AS x, b FROM sub) SELECT up.x, CAST(count(f.b) AS BIGINT) AS n_found, count(*) AS n_wanted, count(*) - count(f.b) AS n_missing, CAST(0 AS BIGINT) AS n_extra FROM up LEFT JOIN f ON f.x = up.x AND f.b = up.b GROUP BY up.x HAVING count(*) > count(f.b)")
def q_compare_classes(spark, sf_dir):
    sub = star.sub(spark, sf_dir)
    return results.compare(pairs(sub, "a"), subclass_closure(sub))


@query(f"WITH RECURSIVE {SUB}, {CLOSURE}, f AS (SELECT DISTINCT a AS x, b FROM sub), e AS (SELECT up.x, avg(CASE WHEN f.b IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM up LEFT JOIN f ON f.x = up.x AND f.b = up.b GROUP BY up.x) SELECT count(*) AS n_classes, round(100 * avg(share), 6) AS percent FROM e")
def q_completeness(spark, sf_dir):
    sub = star.sub(spark, sf_dir)
    return results.completeness(pairs(sub, "a"), subclass_closure(sub))


@query(f"WITH RECURSIVE {SUB}, {CLOSURE}, c AS (SELECT DISTINCT x FROM up) SELECT x, b FROM up UNION SELECT x, x FROM c UNION SELECT x, 'owl:Thing' FROM c UNION SELECT 'region:1', 'zone:1' UNION SELECT 'zone:1', 'region:1'")
def q_expected_supers(spark, sf_dir):
    up = subclass_closure(star.sub(spark, sf_dir))
    return results.expected(up, rows(spark, "x string, y string", ("region:1", "zone:1")), up.select("x").distinct())


@query(f"WITH {SUB} SELECT DISTINCT a || '|' || b AS value FROM sub")
def q_export_lines(spark, sf_dir):
    return results.pair_lines(pairs(star.sub(spark, sf_dir), "a"))


@query(f"WITH RECURSIVE {SUB}, {CLOSURE}, f AS (SELECT DISTINCT a AS x, b FROM sub) SELECT '- ' || x || '|' || b AS value FROM (SELECT * FROM up EXCEPT SELECT * FROM f)")
def q_diff_report(spark, sf_dir):
    sub = star.sub(spark, sf_dir)
    return results.diff_lines(pairs(sub, "a"), subclass_closure(sub))


@query("SELECT 'part:' || p_partkey AS x, CASE WHEN p_brand < 'type:' || p_type THEN p_brand || ',type:' || p_type ELSE 'type:' || p_type || ',' || p_brand END AS found, p_brand AS wanted FROM part")
def q_side_by_side(spark, sf_dir):
    found = pairs(star.part_types(spark, sf_dir).filter(F.col("a").startswith("part:")), "a")
    return results.side_by_side(found, found.filter(F.col("b").startswith("Brand")))


# --- statistics

COUNTS = f"""WITH {SUB}, {EX} SELECT 'sub' AS axiom_type, count(*) AS n FROM (SELECT DISTINCT * FROM sub) UNION ALL SELECT 'ex', count(*) FROM ex UNION ALL
SELECT unnest(['conj', 'exl', 'role', 'chain', 'dom', 'rng']), unnest([3, 2, 3, 3, 1, 1])"""


@query(COUNTS.replace("(SELECT DISTINCT * FROM sub)", "(SELECT * FROM sub UNION ALL SELECT * FROM sub)"))
def q_axiom_counts(spark, sf_dir):
    ax = star.axioms(spark, sf_dir)
    return stats.axiom_counts(ax.with_(sub=ax.sub.unionByName(ax.sub)), distinct=False)


@query(COUNTS)
def q_axiom_counts_dedup(spark, sf_dir):
    ax = star.axioms(spark, sf_dir)
    return stats.axiom_counts(ax.with_(sub=ax.sub.unionByName(ax.sub)))


@query(f"WITH RECURSIVE {SUB}, {EX}, {CLOSURE}, {FULL_S} SELECT 'S' AS relation, count(*) AS n FROM s UNION ALL SELECT 'R', count(*) FROM rel")
def q_closure_counts(spark, sf_dir):
    known = dictionary.identified(star.axioms(spark, sf_dir))
    c = saturate(known.axioms, nothing=known.nothing, top=known.top, ready_made=True)
    return stats.closure_counts(facts(c, known.nothing, known.top), c.r)


@query(f"WITH {SUB}, g AS (SELECT b, count(*) AS n FROM sub GROUP BY b) SELECT count(*) AS n_sets, round(avg(n), 6) AS avg_size, max(n) AS max_size FROM g")
def q_set_size_stats(spark, sf_dir):
    return stats.set_size_stats(pairs(star.sub(spark, sf_dir), "a"), "b")


@query(f"WITH {EX}, g AS (SELECT r, b, count(*) AS n FROM ex GROUP BY r, b) SELECT count(*) AS n_sets, round(avg(n), 6) AS avg_size, max(n) AS max_size FROM g")
def q_role_size_stats(spark, sf_dir):
    return stats.set_size_stats(star.existentials(spark, sf_dir).withColumn("key", F.struct("r", "b")), "key")


@query(f"WITH {SUB} SELECT a AS x, count(*) AS n FROM sub GROUP BY a ORDER BY n DESC, x LIMIT 1")
def q_max_supers(spark, sf_dir):
    return stats.top_sets(pairs(star.sub(spark, sf_dir), "a"), "x")


SHAPES = f"""{SUB}, {EX}, sh AS (SELECT 'class' AS lhs, 'class' AS rhs FROM (SELECT DISTINCT * FROM sub) UNION ALL SELECT 'class', 'existential' FROM ex
  UNION ALL SELECT unnest(['intersection', 'intersection', 'intersection', 'existential', 'existential', 'role', 'role', 'role', 'chain', 'chain', 'chain', 'domain', 'range']), unnest(['class', 'class', 'class', 'class', 'class', 'role', 'role', 'role', 'role', 'role', 'role', 'class', 'class']))"""


@query(f"WITH {SHAPES} SELECT lhs, rhs, count(*) AS n FROM sh GROUP BY lhs, rhs")
def q_shape_histogram(spark, sf_dir):
    return stats.shape_histogram(stats.shapes(star.axioms(spark, sf_dir)))


@query(f"WITH {SHAPES} SELECT lhs, count(*) FILTER (rhs = 'class') AS n_class, count(*) FILTER (rhs = 'existential') AS n_existential, count(*) FILTER (rhs = 'role') AS n_role FROM sh GROUP BY lhs")
def q_shape_crosstab(spark, sf_dir):
    return stats.shape_crosstab(stats.shapes(star.axioms(spark, sf_dir)), ["class", "existential", "role"])


@query("SELECT CAST(month(o_orderdate) AS VARCHAR) AS file, o_orderstatus AS shape, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def q_shape_rollup(spark, sf_dir):
    return stats.shape_rollup(star.read(spark, sf_dir, "orders", "o_orderdate", "o_orderstatus").select(F.month("o_orderdate").cast("string").alias("file"), F.col("o_orderstatus").alias("shape")))


@query("WITH r AS (SELECT row_number() OVER (ORDER BY event_id) AS n, avg(CAST(floor(value) AS BIGINT)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m FROM events) SELECT coalesce(max(n), 0) AS n_within FROM r WHERE m <= 60")
def q_running_mean_threshold(spark, sf_dir):
    costs = star.read(spark, sf_dir, "events", "event_id", "value").select("event_id", F.floor("value").cast("double").alias("cost"))
    return stats.longest_prefix(stats.running_mean(costs, "event_id", "cost"), 60)


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS axioms, CAST(sum(o_custkey) AS BIGINT) AS individuals, CAST(sum(o_orderkey % 1000) AS BIGINT) AS load_ms, round(CAST(sum(o_orderkey % 7) * 60 + sum(o_orderkey % 60) AS DOUBLE), 3) AS classify_s, count(*) AS files FROM orders")
def q_log_metrics(spark, sf_dir):
    """Classification logs with one block of lines for each order."""
    o = star.read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    t = lambda c: F.col(c).cast("string")
    block = F.array(F.concat(t("o_orderkey"), F.lit(" file: /data/x.owl")), F.concat(F.lit("Logical axioms: "), t("o_orderkey")), F.concat(F.lit("Individuals: "), t("o_custkey")), F.concat(F.lit("Time taken (millis): "), (F.col("o_orderkey") % 1000).cast("string")), F.concat(F.lit("real\t"), (F.col("o_orderkey") % 7).cast("string"), F.lit("m"), (F.col("o_orderkey") % 60).cast("string"), F.lit(".000s")))
    return stats.log_metrics(o.select(F.explode(block).alias("value")))


@query("SELECT count(*) FILTER (event_type = 'view') AS abox, count(*) FILTER (event_type IN ('click', 'error')) AS tbox, count(*) FILTER (event_type IN ('purchase', 'signup')) AS rbox FROM events")
def q_box_counts(spark, sf_dir):
    return stats.box_counts(_event_axioms(spark, sf_dir))


def _event_axioms(spark, sf_dir) -> DataFrame:
    """An axiom text for each event, of a kind that depends on its type."""
    e = star.read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    n, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    say = lambda pattern, *args: F.format_string(pattern, *args)
    axiom = (
        F.when(F.col("event_type") == "view", say("ClassAssertion(<Seen> <user:%s>)", u))
        .when(F.col("event_type") == "click", say("SubClassOf(<click:%s> ObjectUnionOf(<A> <user:%s>))", n, u))
        .when(F.col("event_type") == "error", say('SubClassOf(<error:%s> DataHasValue(<code> "%s"^^<xsd:integer>))', n, u))
        .when(F.col("event_type") == "purchase", say("TransitiveObjectProperty(<role:%s>)", u))
        .otherwise(say("FunctionalObjectProperty(<role:%s>)", n))
    )
    return e.select(F.lit("events").alias("file"), F.regexp_extract(axiom, r"^(\w+)\(", 1).alias("kind"), axiom.alias("axiom"))


# --- profile, translations


@query("SELECT CASE event_type WHEN 'view' THEN 'ClassAssertion' WHEN 'error' THEN 'SubClassOf' ELSE 'TransitiveObjectProperty' END AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'error', 'purchase') GROUP BY 1")
def q_profile_filter(spark, sf_dir):
    return profile.split_profile(_event_axioms(spark, sf_dir))[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE event_type WHEN 'click' THEN 'expression ObjectUnionOf' ELSE 'axiom FunctionalObjectProperty' END AS reason, count(*) AS n FROM events WHERE event_type IN ('click', 'signup') GROUP BY 1")
def q_rejected_axioms(spark, sf_dir):
    return profile.profile_report(_event_axioms(spark, sf_dir))


@query("SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'ClassAssertion' AS kind, user_id AS u FROM events WHERE event_type = 'view' UNION ALL SELECT DISTINCT 'TransitiveObjectProperty', user_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'SubClassOf', event_id FROM events WHERE event_type = 'error') GROUP BY kind")
def q_extract_el(spark, sf_dir):
    a = _event_axioms(spark, sf_dir)
    return profile.extract_el(a, a).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM events WHERE event_type <> 'error') AS n_left, 'xsd:integer' AS datatype")
def q_drop_data_values(spark, sf_dir):
    left, kinds = profile.without_data_values(_event_axioms(spark, sf_dir))
    return left.agg(F.count(F.lit(1)).alias("n_left")).crossJoin(F.broadcast(kinds.agg(F.array_join(F.sort_array(F.collect_set("datatype")), ",").alias("datatype"))))


@query("SELECT count(*) AS n FROM events WHERE event_type <> 'error'")
def q_drop_expressions(spark, sf_dir):
    return profile.without_expressions(_event_axioms(spark, sf_dir), ("DataHasValue", "ObjectExactCardinality")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'class' AS side, count(*) AS n, true AS basic FROM nation UNION ALL SELECT 'existential', count(*), false FROM nation UNION ALL SELECT 'nominal', count(*), true FROM nation UNION ALL SELECT 'intersection', count(*), false FROM nation")
def q_side_kinds(spark, sf_dir):
    n = star.read(spark, sf_dir, "nation", "n_nationkey").select(F.col("n_nationkey").cast("string").alias("k"))
    sides = F.array(F.format_string("<n:%s>", "k"), F.format_string("ObjectSomeValuesFrom(<r> <n:%s>)", "k"), F.format_string("ObjectOneOf(<n:%s>)", "k"), F.format_string("ObjectIntersectionOf(<A> <n:%s>)", "k"))
    s = n.select(F.explode(sides).alias("s"))
    return s.groupBy(profile.side_kind(F.col("s")).alias("side"), profile.is_basic(F.col("s")).alias("basic")).agg(F.count(F.lit(1)).alias("n"))


USER = "u AS (SELECT x, row_number() OVER (ORDER BY x) AS n FROM (SELECT DISTINCT 'user:' || user_id AS x FROM events WHERE event_type IN ('view', 'click')))"


@query(f"WITH {USER} SELECT DISTINCT 'C' || n AS a, 'Viewer' AS b FROM u JOIN events e ON u.x = 'user:' || e.user_id WHERE event_type = 'view'")
def q_ind2class(spark, sf_dir):
    e = star.read(spark, sf_dir, "events", "user_id", "event_type")
    who = star.iri("user", "user_id")
    seen = e.filter("event_type = 'view'").select(who.alias("individual"), F.lit("Viewer").alias("class")).distinct()
    met = e.filter("event_type = 'click'").select(who.alias("individual"), F.lit("knows").alias("role"), who.alias("other")).distinct()
    return translate.individuals_to_classes(seen, met)[1]


@query(f"WITH {USER} SELECT DISTINCT 'C' || n AS a, 'knows' AS r, 'C' || n AS b FROM u JOIN events e ON u.x = 'user:' || e.user_id WHERE event_type = 'click'")
def q_ind2class_roles(spark, sf_dir):
    e = star.read(spark, sf_dir, "events", "user_id", "event_type")
    who = star.iri("user", "user_id")
    seen = e.filter("event_type = 'view'").select(who.alias("individual"), F.lit("Viewer").alias("class")).distinct()
    met = e.filter("event_type = 'click'").select(who.alias("individual"), F.lit("knows").alias("role"), who.alias("other")).distinct()
    return translate.individuals_to_classes(seen, met)[2]


@query("SELECT 'customer:' || c_custkey AS individual, 'segment:' || c_mktsegment AS class FROM customer")
def q_nominal_translate(spark, sf_dir):
    people = star.read(spark, sf_dir, "customer", "c_custkey").select(star.iri("customer", "c_custkey").alias("x"))
    return translate.nominals_to_assertions(star.sub(spark, sf_dir), star.existentials(spark, sf_dir), people)[0]


@query("SELECT 'order:' || o_orderkey AS individual, 'placedBy' AS role, 'customer:' || o_custkey AS other FROM orders")
def q_nominal_translate_roles(spark, sf_dir):
    c = star.read(spark, sf_dir, "customer", "c_custkey").select(star.iri("customer", "c_custkey").alias("x"))
    o = star.read(spark, sf_dir, "orders", "o_orderkey").select(star.iri("order", "o_orderkey").alias("x"))
    return translate.nominals_to_assertions(star.sub(spark, sf_dir), star.existentials(spark, sf_dir), c.unionByName(o))[1]


@query("SELECT 'contains' AS r, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def q_range_inspection(spark, sf_dir):
    return translate.with_ranges(star.existentials(spark, sf_dir), rows(spark, "r string, d string", *star.RANGES))


@query("SELECT 'customer:' || c_custkey AS a, 'group:' || c_nationkey AS b FROM customer")
def q_nominal_expand(spark, sf_dir):
    sets = star.read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").groupBy(star.iri("group", "c_nationkey").alias("b")).agg(F.collect_set(star.iri("customer", "c_custkey")).alias("individuals"))
    return translate.expand_nominals(sets)


# --- documents and normal forms


@query("""SELECT 'SubClassOf' AS kind, 'SubClassOf(<nation:' || n_nationkey || '> <region:' || n_regionkey || '>)' AS axiom FROM nation
UNION ALL SELECT 'SubClassOf', 'SubClassOf(<nation:' || n_nationkey || '> ObjectSomeValuesFrom(<inRegion> <region:' || n_regionkey || '>))' FROM nation UNION ALL SELECT 'Import', 'http://example.org/base'""")
def q_owl_parse(spark, sf_dir):
    """Documents with prefixes, comments and an import, one for each region."""
    n = star.read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_regionkey").cast("string").alias("r"))
    body = F.format_string("SubClassOf(n:%s g:%s)\n# a remark\nSubClassOf(n:%s ObjectSomeValuesFrom(<inRegion> g:%s))", "n", "r", "n", "r")
    docs = n.groupBy("r").agg(F.array_join(F.sort_array(F.collect_list(body)), "\n").alias("body"))
    text = F.concat(F.lit("Prefix(n:=<nation:>)\nPrefix(g:=<region:>)\nOntology(<http://example.org/"), "r", F.lit(">\nImport(<http://example.org/base>)\n"), "body", F.lit("\n)"))
    return owl.parse_documents(docs.select(F.col("r").alias("file"), text.alias("text"))).select("kind", "axiom").distinct()


@query("SELECT 'sub' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'ex', count(*) FROM nation UNION ALL SELECT 'rejected', 2 * count(*) FROM nation UNION ALL SELECT 'unread', 1")
def q_normaliser_job(spark, sf_dir):
    """A folder of documents, one of them broken, through the normaliser job; odd axioms are rejected, not fatal."""
    n = star.read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_regionkey").cast("string").alias("r"))
    body = F.format_string("SubClassOf(<n:%s> ObjectIntersectionOf(<g:%s> ObjectSomeValuesFrom(<in> <g:%s>))) ClassAssertion(<A> ObjectOneOf(<i:%s>)) SubClassOf(<A> ObjectUnionOf(<B> <n:%s>))", "n", "r", "r", "n", "n")
    folder = fresh_path(spark, "documents")
    n.select(body.alias("value")).write.option("lineSep", " ").text(folder)
    rows(spark, "value string", ("SubClassOf(<A>",)).write.mode("append").text(folder)
    return normaliser.normaliser_job(spark, folder, fresh_path(spark, "normalised"))


@query("SELECT 'segment:' || c_mktsegment AS b, count(*) AS n_found, count(*) FILTER (c_nationkey <> 1) AS n_wanted, CAST(0 AS BIGINT) AS n_missing, count(*) FILTER (c_nationkey = 1) AS n_extra FROM customer GROUP BY c_mktsegment HAVING count(*) FILTER (c_nationkey = 1) > 0")
def q_compare_instances(spark, sf_dir):
    c = star.read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(star.iri("customer", "c_custkey").alias("x"), star.iri("segment", "c_mktsegment").alias("b"), "c_nationkey")
    return results.compare_instances(c.select("x", "b"), c.filter("c_nationkey <> 1").select("x", "b"))


@query("""SELECT o_orderstatus AS file, count(DISTINCT o_orderpriority) AS classes, count(DISTINCT o_custkey) AS individuals, CAST(0 AS BIGINT) AS roles FROM orders GROUP BY 1
UNION ALL SELECT NULL, count(DISTINCT o_orderpriority), count(DISTINCT o_custkey), 0 FROM orders""")
def q_signature_rollup(spark, sf_dir):
    o = star.read(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority", "o_custkey")
    classes = o.select(F.col("o_orderstatus").alias("file"), star.iri("priority", "o_orderpriority").alias("iri"), F.lit(0).alias("kind"))
    return stats.signature_rollup(classes.unionByName(o.select(F.col("o_orderstatus").alias("file"), star.iri("customer", "o_custkey").alias("iri"), F.lit(1).alias("kind"))))


@query("SELECT count(*) AS axioms, count(DISTINCT n_regionkey) + count(*) AS concepts, CAST(1 AS BIGINT) AS individuals, CAST(1 AS BIGINT) AS roles FROM nation")
def q_load_metrics(spark, sf_dir):
    ex = star.existentials(spark, sf_dir).filter("r = 'inRegion'")
    return stats.load_metrics(Axioms.of(spark, ex=ex, individuals=rows(spark, "x string", ("someone",))))


@query("SELECT 's' AS key, 'customer:' || c_custkey AS member, CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS DOUBLE) END AS score FROM customer")
def q_score_lookup(spark, sf_dir):
    """Scores of members after some were removed from a keyed store."""
    c = star.read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(F.lit("s").alias("key"), star.iri("customer", "c_custkey").alias("member"), F.col("c_nationkey").cast("double").alias("score"))
    store = sinks.KeyedStore(spark, fresh_path(spark, "store"))
    store.append(c.unionByName(c.withColumn("key", F.lit("gone"))))
    store.remove(c.filter("score = 3"))
    store.delete_keys("^gone$")
    return store.scores(c)


@query(f"WITH {EX} SELECT 'SubClassOf(<' || a || '> ObjectSomeValuesFrom(<' || r || '> <' || b || '>))' AS value FROM ex WHERE r IN ('inNation', 'inRegion')")
def q_owl_write(spark, sf_dir):
    return owl.normal_form_lines("ex", star.existentials(spark, sf_dir).filter(F.col("r").isin("inNation", "inRegion")))


@query("""SELECT 'order:' || o_orderkey AS x, 'Wanted' AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'""")
def q_normalise_nested(spark, sf_dir):
    """A nested definition is split into normal forms whose closure finds the same orders as a join."""
    text = "SubClassOf(ObjectIntersectionOf(<status:O> ObjectSomeValuesFrom(<placedBy> ObjectIntersectionOf(<segment:BUILDING> ObjectSomeValuesFrom(<inNation> <region:1>)))) <Wanted>)"
    tables, _ = normalize.normalise(rows(spark, "axiom string", (text,)))
    ex = star.existentials(spark, sf_dir).filter(F.col("r").isin("placedBy", "inNation"))
    c = saturate(tables.with_(sub=tables.sub.unionByName(star.sub(spark, sf_dir)), ex=ex))
    return setops.members(facts(c), "Wanted")


@query("SELECT 'sub' AS kind, count(*) * 6 + 1 AS n FROM nation UNION ALL SELECT 'ex', count(*) FROM nation UNION ALL SELECT 'rejected', count(*) FROM nation UNION ALL SELECT 'chain', 1 UNION ALL SELECT 'conj', 1 UNION ALL SELECT 'role', 2")
def q_normal_form_kinds(spark, sf_dir):
    """Kinds of rows that a mixed ontology is rewritten to."""
    n = star.read(spark, sf_dir, "nation", "n_nationkey").select(F.col("n_nationkey").cast("string").alias("k"))
    per = F.array(F.format_string("SubClassOf(<n:%s> ObjectIntersectionOf(<A> <B> ObjectSomeValuesFrom(<r> ObjectIntersectionOf(<C> <D:%s>))))", "k", "k"), F.format_string("SubClassOf(<n:%s> ObjectUnionOf(<A> <B>))", "k"), F.format_string("EquivalentClasses(<n:%s> <m:%s>)", "k", "k"), F.lit("SubClassOf(<http://www.w3.org/2002/07/owl#Nothing> <A>)"))
    fixed = rows(spark, "axiom string", ("TransitiveObjectProperty(<r>)",), ("DisjointClasses(<A> <B>)",), ("EquivalentObjectProperties(<r> <s>)",), ("ClassAssertion(<A> <i>)",))
    text = n.select(F.explode(per).alias("axiom")).unionByName(fixed)
    distinct = normalize.normal_form(text).filter("kind != 'individual'").select("kind", "a", "r", "b", "operands", "axiom").distinct()
    return distinct.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- generators, sets, placement


@query(f"WITH {SUB}, k AS (SELECT unnest(range(1, 4)) AS i) SELECT a || '_' || i AS a, b || '_' || i AS b FROM sub, k")
def q_multiply(spark, sf_dir):
    return generate.multiply(Axioms.of(spark, sub=star.sub(spark, sf_dir)), 3).sub


@query("""WITH s AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation), o AS (SELECT iri, row_number() OVER (ORDER BY iri) % 2 AS odd FROM (SELECT a AS iri FROM s UNION SELECT b FROM s)),
m AS (SELECT a, b, x.odd AS oa, y.odd AS ob FROM s JOIN o x ON x.iri = a JOIN o y ON y.iri = b)
SELECT a || CASE WHEN oa = 1 THEN '_1' ELSE '_2' END AS a, b || CASE WHEN ob = 1 THEN '_1' ELSE '_2' END AS b FROM m UNION ALL SELECT a || CASE WHEN oa = 1 THEN '_2' ELSE '_1' END, b || CASE WHEN ob = 1 THEN '_2' ELSE '_1' END FROM m""")
def q_cross_multiply(spark, sf_dir):
    nation = star.read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return generate.cross_multiply(nation.select(star.iri("nation", "n_nationkey").alias("a"), star.iri("region", "n_regionkey").alias("b")))


@query(f"WITH {SUB} SELECT a, b FROM sub UNION SELECT a || '_1', b || '_1' FROM sub")
def q_merge(spark, sf_dir):
    sub = star.sub(spark, sf_dir)
    return generate.merge(sub, sub, generate.copies(sub, ["a", "b"], 1))


@query("SELECT CAST(1000 AS BIGINT) AS n_individuals, CAST(20000 AS BIGINT) AS n_assertions, true AS share_fits")
def q_random_abox(spark, sf_dir):
    """Size and shares of a random ABox."""
    people = generate.individuals(spark, 1000)
    a, b = generate.random_assertions(spark, 1000, 20_000, ["r", "s"])
    shares = a.select(F.lit(1).alias("c")).unionByName(b.select(F.lit(0).alias("c"))).agg(F.count(F.lit(1)).alias("n_assertions"), (F.abs(F.avg("c") - 0.7) < 0.02).alias("share_fits"))
    return people.agg(F.count(F.lit(1)).alias("n_individuals")).crossJoin(F.broadcast(shares))


@query(f"WITH {SUB} SELECT a AS x, b FROM sub UNION SELECT b, a FROM sub")
def q_union(spark, sf_dir):
    s = star.sub(spark, sf_dir)
    return setops.union(pairs(s, "a"), s.select(F.col("b").alias("x"), F.col("a").alias("b")))


@query("SELECT x FROM (SELECT 'order:' || o_orderkey AS x FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT 'order:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_intersect(spark, sf_dir):
    s = pairs(star.sub(spark, sf_dir), "a")
    return setops.intersect(setops.members(s, "status:F").select("x"), setops.members(s, "priority:1-URGENT").select("x"))


@query("SELECT x FROM (SELECT 'order:' || o_orderkey AS x FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT 'order:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_except(spark, sf_dir):
    s = pairs(star.sub(spark, sf_dir), "a")
    return setops.minus(setops.members(s, "status:F").select("x"), setops.members(s, "priority:1-URGENT").select("x"))


@query("SELECT 'part:' || p_partkey AS x, p_size AS round FROM part WHERE p_size BETWEEN 10 AND 20")
def q_range_by_score(spark, sf_dir):
    return setops.by_score(star.read(spark, sf_dir, "part", "p_partkey", "p_size").select(star.iri("part", "p_partkey").alias("x"), F.col("p_size").alias("round")), 10, 20)


@query("SELECT p_brand AS b, max(p_size) AS top_score FROM part GROUP BY p_brand")
def q_top_score(spark, sf_dir):
    return setops.top_score(star.read(spark, sf_dir, "part", "p_brand", "p_size").select(F.col("p_brand").alias("b"), F.col("p_size").alias("round")), "b")


@query("SELECT 'part:' || p_partkey AS x, p_size AS round FROM part ORDER BY p_size, x LIMIT 10")
def q_range_by_rank(spark, sf_dir):
    p = star.read(spark, sf_dir, "part", "p_partkey", "p_size").select(star.iri("part", "p_partkey").alias("x"), F.col("p_size").alias("round"))
    return setops.by_rank(p, 10, "round", "x")


@query("SELECT 'orders:open' AS b, 'order:' || o_orderkey AS x FROM orders WHERE o_orderstatus IN ('O', 'P')")
def q_union_store(spark, sf_dir):
    s = pairs(star.sub(spark, sf_dir), "a")
    return setops.union_store(s, rows(spark, "b string", ("status:O",), ("status:P",)), "b", "x", "orders:open")


@query("SELECT 'customer:' || c_custkey AS x, 'segment:BUILDING' AS b, c_mktsegment = 'BUILDING' AS found FROM customer")
def q_membership(spark, sf_dir):
    asked = star.read(spark, sf_dir, "customer", "c_custkey").select(star.iri("customer", "c_custkey").alias("x"), F.lit("segment:BUILDING").alias("b"))
    return setops.contained(pairs(star.sub(spark, sf_dir), "a"), asked, ["x", "b"])


@query("SELECT 'customer:' || c_custkey AS x, 'segment:' || c_mktsegment AS b, 2 AS round FROM customer WHERE c_mktsegment <> 'BUILDING'")
def q_insert_new(spark, sf_dir):
    s = pairs(star.sub(spark, sf_dir), "a").filter(F.col("x").startswith("customer:"))
    return setops.insert_new(setops.members(s, "segment:BUILDING"), s.unionByName(s), ["x", "b"], 2)


def _rule_counts(spark, sf_dir) -> dict[str, int]:
    return {r.axiom_type: r.n for r in stats.axiom_counts(star.axioms(spark, sf_dir)).collect()}


SCORES = f"""c AS (WITH {SUB}, {EX} SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM sub)) AS sub, (SELECT count(*) FROM ex) AS ex),
sc AS (SELECT unnest(['sub', 'conj', 'ex', 'exl', 'exl_join', 'role', 'chain']) AS rule, unnest([sub, 6, ex, 2, 8 * (ex + 8), 3 * (ex + 6), 3 * (ex + 6)]) AS score FROM c)"""


@query(f"WITH {SCORES}, w AS (SELECT rule, score, 1 + floor(17 * score / (SELECT sum(score) FROM sc)) AS base, row_number() OVER (ORDER BY score DESC, rule) AS n FROM sc) SELECT rule, CAST(score AS BIGINT) AS score, CAST(base + CASE WHEN n <= 24 - (SELECT sum(base) FROM w) THEN 1 ELSE 0 END AS BIGINT) AS workers FROM w")
def q_placement_scores(spark, sf_dir):
    return placement.placement(spark, _rule_counts(spark, sf_dir), 24)


@query(f"WITH {SCORES} SELECT rule, CAST(score AS BIGINT) AS score FROM sc ORDER BY score DESC, rule LIMIT 3")
def q_topk_types(spark, sf_dir):
    return placement.placement(spark, _rule_counts(spark, sf_dir), 24).select("rule", "score").orderBy(F.desc("score"), "rule").limit(3)


@query("WITH p AS (SELECT l_returnflag AS rule, min(l_tax) AS done FROM lineitem WHERE l_tax < 1 GROUP BY 1) SELECT rule, done FROM p ORDER BY done, rule LIMIT 1")
def q_least_complete(spark, sf_dir):
    return placement.least_complete(star.read(spark, sf_dir, "lineitem", "l_returnflag", "l_tax").select(F.col("l_returnflag").alias("rule"), F.col("l_tax").alias("done")))


@query(f"WITH {EX} SELECT a AS x, b AS y FROM ex WHERE r = 'placedBy'")
def q_role_values(spark, sf_dir):
    return results.role_values(star.existentials(spark, sf_dir).select("r", F.col("a").alias("x"), F.col("b").alias("y")), "placedBy")


@query("SELECT page_id, '<rdf:RDF>' || coalesce(html, '') || '</rdf:RDF>' AS html FROM pages")
def q_wrap_documents(spark, sf_dir):
    return sinks.wrap_documents(star.read(spark, sf_dir, "pages", "page_id", "html"), "html", "<rdf:RDF>", "</rdf:RDF>")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_hierarchy_closure(spark, sf_dir)
