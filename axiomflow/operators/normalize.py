"""Rewriting of axioms to normal form, one axiom at a time.

New names are hashes of the expression that they stand for, so equal expressions get one name in all tasks and runs
and nothing has to be looked up. Range axioms are taken out by a join over the whole ontology.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomflow.operators import rules
from axiomflow.plans.saturate import role_closure
from axiomflow.schema import BOTTOM, TOP, Axioms
from axiomflow.storage import fresh_path, small
from axiomflow.sources.owl import OWL_NOTHING, OWL_THING, parse_axiom, written

FRESH_CLASS, FRESH_ROLE = "urn:fresh:class:", "urn:fresh:role:"
#: Begins a text that stands for the fresh class named by its hash; no IRI holds a control character.
FRESH_TEXT = "\x01"
ROW = "kind string, a string, r string, b string, operands array<string>, axiom string, reason string"
#: Expressions that stay by themselves: a class, a datatype or an individual (as a nominal).
Expression = tuple


class Unsupported(Exception):
    pass


def expression(tree) -> Expression:
    """("name", iri), ("and", ...), ("some", role, filler), ("each", individuals): a set of several individuals."""
    if isinstance(tree, str):
        return ("name", {OWL_THING: TOP, OWL_NOTHING: BOTTOM}.get(tree, tree))
    op, args = tree[0], tree[1:]
    if op == "ObjectIntersectionOf":
        flat: list[Expression] = []
        for a in map(expression, args):
            flat += a[1:] if a[0] == "and" else [a]
        parts = tuple(sorted(set(flat) - {("name", TOP)}, key=repr))
        return parts[0] if len(parts) == 1 else ("and", *parts) if parts else ("name", TOP)
    if op in ("ObjectSomeValuesFrom", "DataSomeValuesFrom"):
        return ("some", _role(args[0]), expression(args[1]))
    if op == "ObjectHasValue":
        return ("some", _role(args[0]), ("name", _name(args[1])))
    if op == "DataHasValue":  # of the literal only its datatype is kept
        return ("some", _role(args[0]), ("name", _datatype(_name(args[1]))))
    if op == "ObjectOneOf":
        each = tuple(map(_name, args))
        return ("name", each[0]) if len(each) == 1 else ("each", *each)
    raise Unsupported(op)


def _role(tree) -> str:
    if isinstance(tree, list):
        raise Unsupported(tree[0])
    return tree


def _name(tree) -> str:
    """An individual or a literal, where no expression may stand."""
    if isinstance(tree, list):
        raise Unsupported(f"{tree[0]} where a name is due")
    return tree


def _datatype(literal: str) -> str:
    """The datatype's IRI of a literal; "plain" ones are strings."""
    kind = literal.rpartition('"')[2]
    return kind[2:].strip("<>") if kind.startswith("^^") else "http://www.w3.org/2001/XMLSchema#string"


def fresh_class(e: Expression) -> str:
    return FRESH_CLASS + hashlib.sha256(repr(e).encode()).hexdigest()[:32]


def _individuals(tree, op: str = "") -> Iterator[str]:
    if isinstance(tree, list):
        if tree[0] == "ObjectOneOf":
            yield from map(_name, tree[1:])
        elif tree[0] == "ObjectHasValue":
            yield _name(tree[2])
        for t in tree[1:]:
            yield from _individuals(t)


def normal_rows(tree) -> list[tuple]:
    """Normal-form rows (kind, a, r, b, operands) of one axiom; raises Unsupported."""
    out: list[tuple] = []
    todo: list[tuple[Expression, Expression]] = []
    op, args = tree[0], tree[1:]
    for i in _individuals(tree):
        out.append(("individual", i, None, None, None))
    if op == "SubClassOf":
        todo.append((expression(args[0]), expression(args[1])))
    elif op == "EquivalentClasses":
        members = list(map(expression, args))
        todo += [(x, y) for i, x in enumerate(members) for j, y in enumerate(members) if i != j]
    elif op == "DisjointClasses":
        members = list(map(expression, args))
        todo += [(expression_and(x, y), ("name", BOTTOM)) for i, x in enumerate(members) for y in members[i + 1 :]]
    elif op == "ClassAssertion":
        out.append(("individual", _name(args[1]), None, None, None))
        todo.append((("name", args[1]), expression(args[0])))
    elif op == "ObjectPropertyAssertion":
        out += [("individual", _name(args[1]), None, None, None), ("individual", _name(args[2]), None, None, None)]
        todo.append((("name", args[1]), ("some", _role(args[0]), ("name", args[2]))))
    elif op == "DataPropertyAssertion":
        out.append(("individual", _name(args[1]), None, None, None))
        todo.append((("name", args[1]), ("some", _role(args[0]), ("name", _datatype(_name(args[2]))))))
    elif op in ("SubObjectPropertyOf", "SubDataPropertyOf"):
        if isinstance(args[0], list) and args[0][0] == "ObjectPropertyChain":
            out += _chain([_role(r) for r in args[0][1:]], _role(args[1]))
        else:
            out.append(("role", None, _role(args[0]), _role(args[1]), None))
    elif op in ("EquivalentObjectProperties", "EquivalentDataProperties"):
        out += [("role", None, _role(x), _role(y), None) for x in args for y in args if x != y]
    elif op == "TransitiveObjectProperty":
        out.append(("chain", _role(args[0]), _role(args[0]), _role(args[0]), None))
    elif op in ("ObjectPropertyDomain", "DataPropertyDomain", "ObjectPropertyRange"):
        d = expression(args[1])
        if d[0] == "and" and op == "ObjectPropertyRange":
            for part in d[1:]:
                out += _range(_role(args[0]), part, todo)
        elif op == "ObjectPropertyRange":
            out += _range(_role(args[0]), d, todo)
        else:
            name = _named_above(d, todo)
            out.append(("dom", None, _role(args[0]), name, None))
    elif op == "Declaration":
        if args and isinstance(args[0], list) and args[0][0] == "NamedIndividual":
            out.append(("individual", _name(args[0][1]), None, None, None))
        elif args and isinstance(args[0], list) and args[0][0] == "Class":
            name = expression(_name(args[0][1]))[1]
            out.append(("sub", name, None, name, None))
    else:
        raise Unsupported(op)
    while todo:
        out += _inclusion(*todo.pop(), todo)
    return list(dict.fromkeys(out))


def expression_and(*parts: Expression) -> Expression:
    flat = {q for p in parts for q in (p[1:] if p[0] == "and" else [p])} - {("name", TOP)}
    ordered = tuple(sorted(flat, key=repr))
    return ordered[0] if len(ordered) == 1 else ("and", *ordered) if ordered else ("name", TOP)


def _named_above(e: Expression, todo: list) -> str:
    """A name that is below e: e itself, or a new one with an axiom for it."""
    if e[0] == "name":
        return e[1]
    if e[0] == "each":
        raise Unsupported("ObjectOneOf of several individuals on the right")
    name = fresh_class(e)
    todo.append((("name", name), e))
    return name


def _named_below(e: Expression, todo: list) -> str:
    """A name that is above e."""
    if e[0] == "name":
        return e[1]
    name = fresh_class(e)
    todo.append((e, ("name", name)))
    return name


def _range(role: str, d: Expression, todo: list) -> list[tuple]:
    return [("rng", None, role, _named_above(d, todo), None)]


def _chain(roles: list[str], above: str) -> list[tuple]:
    """A chain of n roles by n - 1 chains of two; a chain of one role is a plain inclusion."""
    if not roles:
        raise Unsupported("empty ObjectPropertyChain")
    if len(roles) == 1:
        return [("role", None, roles[0], above, None)]
    out, first = [], roles[0]
    for i, r in enumerate(roles[1:], 2):
        to = above if i == len(roles) else FRESH_ROLE + hashlib.sha256(" ".join(roles[:i]).encode()).hexdigest()[:32]
        out.append(("chain", first, r, to, None))
        first = to
    return out


def _inclusion(c: Expression, d: Expression, todo: list) -> list[tuple]:
    """Rows of c below d, putting what has to be rewritten further on todo."""
    if c == ("name", BOTTOM) or d == ("name", TOP) or c == d and c[0] != "name":
        return []
    if d[0] == "and":
        todo += [(c, part) for part in d[1:]]
        return []
    if d[0] == "each":
        raise Unsupported("ObjectOneOf of several individuals on the right")
    if c[0] == "each":
        todo += [(("name", i), d) for i in c[1:]]
        return []
    if c[0] != "name" and d[0] != "name":
        name = fresh_class(c)
        todo += [(c, ("name", name)), (("name", name), d)]
        return []
    if d[0] == "some":
        return [("ex", c[1], d[1], _named_above(d[2], todo), None)]
    if c[0] == "some":
        if c[2][0] == "each":
            todo += [(("some", c[1], ("name", i)), d) for i in c[2][1:]]
            return []
        return [("exl", _named_below(c[2], todo), c[1], d[1], None)]
    if c[0] == "and":
        if any(part == ("name", BOTTOM) for part in c[1:]):
            return []
        names = sorted({_named_below(part, todo) for part in c[1:]})
        out = []
        while len(names) > 2:  # binary, with a shared name for each pair
            first = names[:2]
            name = fresh_class(("and", *(("name", n) for n in first)))
            out.append(("conj", None, None, name, tuple(first)))
            names = [name, *names[2:]]
        return [*out, ("conj", None, None, d[1], tuple(names))] if len(names) == 2 else [*out, ("sub", names[0], None, d[1], None)]
    return [("sub", c[1], None, d[1], None)]


def normal_form(axioms: DataFrame, axiom_col: str = "axiom") -> DataFrame:
    """Rows (kind, a, r, b, operands, axiom, reason) of axioms in functional syntax; kind is rejected where an axiom
    isn't supported, with the reason. Null axioms are left out."""
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.string()]
    schema = T._parse_datatype_string(ROW)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0).to_pylist():
                try:
                    rows += [(*r, None, None) for r in normal_rows(parse_axiom(text))]
                except RecursionError:
                    rows.append(("rejected", None, None, None, None, text, "nested too deeply"))
                except (Unsupported, ValueError, IndexError, KeyError) as e:
                    rows.append(("rejected", None, None, None, None, text, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

    return axioms.select(F.col(axiom_col)).filter(F.col(axiom_col).isNotNull()).mapInArrow(run, schema)


def tables_of(rows: DataFrame) -> Axioms:
    """Axiom tables of normal-form rows, without repeated axioms."""
    of = lambda kind, **columns: rows.filter(F.col("kind") == kind).select(*[F.col(v).alias(k) for k, v in columns.items()]).distinct()
    pairs = rows.filter("kind = 'conj'").select("operands", "b").distinct()
    conj = pairs.select(F.xxhash64("operands", "b").alias("conj_id"), F.explode("operands").alias("operand"), F.size("operands").alias("arity"), "b")
    return Axioms(
        sub=of("sub", a="a", b="b"), conj=conj, ex=of("ex", a="a", r="r", b="b"), exl=of("exl", r="r", a="a", b="b"), role=of("role", r="r", s="b"),
        chain=of("chain", r="a", s="r", t="b"), dom=of("dom", r="r", d="b"), rng=of("rng", r="r", d="b"), individuals=of("individual", x="a"),
    )


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'rejected'").select("axiom", F.regexp_extract("axiom", r"^(\w+)\(", 1).alias("kind"), "reason")


def eliminate_ranges(ax: Axioms, texts: bool = False) -> Axioms:
    """Range axioms folded into existentials on the right: a below some r.b becomes a below some r.X with X below b and
    below each range of r and of the roles above r. X is one for each r and b. Individuals keep their own name
    and get the ranges themselves. With ``texts`` a fresh class has its text in place of the hash, for inline ids,
    and axioms may stand twice."""
    if ax.rng.isEmpty():
        return ax
    closure = role_closure(ax.role)
    ranges = ax.rng.unionByName(closure.join(ax.rng.withColumnRenamed("r", "s"), "s").select("r", "d")).distinct()
    ranges = small(ranges)
    people = ax.individuals.select(F.col("x").alias("b"))
    hit = ax.ex.join(ranges.select("r"), "r", "left_semi")
    single, several = hit.join(people, "b", "left_semi"), hit.join(people, "b", "left_anti")
    text = F.concat_ws("|", F.lit("range"), "r", "b")
    fresh = F.concat(F.lit(FRESH_TEXT), text) if texts else F.concat(F.lit(FRESH_CLASS), F.sha2(text, 256).substr(1, 32))
    named = several.withColumn("x", fresh)
    fillers = named.select("x", "r", "b").distinct()
    below = rules.union([fillers.select(F.col("x").alias("a"), "b"), fillers.join(ranges, "r").select(F.col("x").alias("a"), F.col("d").alias("b")), single.join(ranges, "r").select(F.col("b").alias("a"), F.col("d").alias("b"))])
    rest = ax.ex.join(ranges.select("r"), "r", "left_anti").select("a", "r", "b")
    ex = rest.unionByName(single.select("a", "r", "b")).unionByName(named.select("a", "r", F.col("x").alias("b")))
    sub = ax.sub.unionByName(below)
    return ax.with_(sub=sub if texts else sub.distinct(), ex=ex, rng=ax.rng.limit(0))


def normalise(axioms: DataFrame, ranges: bool = True) -> tuple[Axioms, DataFrame]:
    """Normal-form tables of axiom rows, and the rejected ones (axiom, kind, reason)."""
    # written once: nine tables are read from it, each from its own folder of a kind
    path = fresh_path(axioms.sparkSession, "normal-form")
    normal_form(axioms).write.partitionBy("kind").parquet(path)
    rows = axioms.sparkSession.read.schema(ROW).parquet(path)
    tables = tables_of(rows)
    return (eliminate_ranges(tables) if ranges else tables), rejected(rows)



def rejected_totals(rows: DataFrame) -> DataFrame:
    """(kind, n): how many axioms were rejected."""
    return rows.agg(F.lit("rejected").alias("kind"), F.count(F.lit(1)).alias("n"))
