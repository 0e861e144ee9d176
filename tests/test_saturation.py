"""Golden micro-ontologies and properties of saturation."""

import pytest

from axiomflow.operators import generate, normalize, results
from axiomflow.plans.saturate import extend, facts, role_closure, saturate, subclass_closure
from axiomflow.schema import BOTTOM, TOP, Axioms
from axiomflow.streaming.incremental import IncrementalClassifier

#: axioms, expected S beyond reflexive facts and top, expected R
GOLDEN = {
    "f1": ({"sub": ["AB", "BC"]}, ["AB", "AC", "BC"], []),
    "f2": ({"sub": ["AB", "AC"], "conj": [("BC", "D")]}, ["AB", "AC", "AD"], []),
    "f3": ({"ex": ["ArB"], "sub": ["BC"], "exl": ["rCD"]}, ["AD", "BC"], ["rAB"]),
    "f4": ({"ex": ["ArB"], "role": ["rs", "st"], "exl": ["tBD"]}, ["AD"], ["rAB", "sAB", "tAB"]),
    "f5": ({"ex": ["ArB", "BsC"], "chain": ["rst", "rpq"], "exl": ["tCD", "qCE"]}, ["AD"], ["rAB", "sBC", "tAC"]),
    "f6": ({"ex": ["ArB"], "sub": ["BC", "BD"], "conj": [("CD", "!")]}, ["A!", "B!", "BC", "BD"], ["rAB"]),
    "f7": ({"ex": ["ArB"], "dom": ["rX", "rY"], "sub": ["XE"]}, ["AX", "AY", "AE", "XE"], ["rAB"]),
    "f8": ({"ex": ["ApB", "BpC", "CpD"], "chain": ["ppp"], "exl": ["pDE"]}, ["AE", "BE", "CE"], ["pAB", "pAC", "pAD", "pBC", "pBD", "pCD"]),
    "f9": ({"sub": ["AB", "BA", "BC"]}, ["AB", "AC", "BA", "BC"], []),
    "f10": ({"ex": ["ArX"], "sub": ["XB", "XD"], "exl": ["rDE"]}, ["AE", "XB", "XD"], ["rAX"]),
}


def names(prefix, word):
    return tuple(BOTTOM if c == "!" else f"{prefix}:{c}" for c in word)


def golden_axioms(spark, keys):
    tables = {}
    for f in keys:
        for kind, rows in GOLDEN[f][0].items():
            for row in rows:
                tables.setdefault(kind, []).append((names(f, row[0]), names(f, row[1])[0]) if kind == "conj" else names(f, row))
    return Axioms.from_lists(spark, **tables)


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def closure(spark):
    return saturate(golden_axioms(spark, GOLDEN))


def test_golden_subsumptions(closure):
    assert as_set(facts(closure)) == {names(f, w) for f, (_, s, _) in GOLDEN.items() for w in s}


def test_golden_role_pairs(closure):
    assert as_set(closure.r.select("r", "x", "y")) == {names(f, w) for f, (_, _, r) in GOLDEN.items() for w in r}


def test_rounds_and_metrics(closure):
    figures = closure.metrics_frame().orderBy("round").collect()
    assert figures[-1].new_s == figures[-1].new_r == 0 and len(figures) == closure.rounds
    assert closure.s.count() == sum(f.new_s for f in figures)
    assert closure.s.select("x", "b").distinct().count() == closure.s.count()


def test_top(spark):
    c = saturate(Axioms.from_lists(spark, sub=[(TOP, "A")], ex=[("B", "r", "C")], exl=[("r", TOP, "D")]))
    assert as_set(facts(c)) == {("B", "A"), ("B", "D"), ("C", "A"), ("D", "A"), (TOP, "A")}


def test_increments_equal_batch(spark, closure):
    whole = golden_axioms(spark, GOLDEN)
    base = golden_axioms(spark, ["f1", "f2", "f3", "f9"])
    grown = saturate(base.with_(conj=base.conj.limit(0), exl=base.exl.limit(0)))
    extend(grown, whole)
    assert as_set(facts(grown)) == as_set(facts(closure))
    assert as_set(grown.r.select("r", "x", "y")) == as_set(closure.r.select("r", "x", "y"))


def test_new_roles_reach_old_pairs(spark):
    c = saturate(Axioms.from_lists(spark, ex=[("A", "r", "B"), ("B", "s", "C")]))
    extend(c, Axioms.from_lists(spark, role=[("r", "s")], chain=[("s", "s", "s")]))
    assert as_set(c.r.select("r", "x", "y")) == {("r", "A", "B"), ("s", "B", "C"), ("s", "A", "B"), ("s", "A", "C")}


def test_multiplied_ontology(spark):
    ax = golden_axioms(spark, ["f2", "f3"])
    assert facts(saturate(generate.multiply(ax, 3))).count() == 3 * 5


def test_role_closure_of_cycle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "r string, s string")
    assert as_set(role_closure(df)) == {(x, y) for x in "abc" for y in "abc" if x != y}


def test_subclass_closure_depths(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "c")], "a string, b string")
    assert as_set(subclass_closure(df).select("x", "b", "depth")) == {("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1), ("d", "c", 1), ("b", "d", 2), ("a", "d", 2)}


def test_ranges_only_reach_fillers(spark):
    ax = Axioms.from_lists(spark, ex=[("A", "r", "B")], role=[("r", "s")], rng=[("s", "D")], exl=[("r", "D", "E"), ("s", "B", "F")])
    found = as_set(facts(saturate(normalize.eliminate_ranges(ax))))
    assert {("A", "E"), ("A", "F")} <= found and ("B", "D") not in found


def test_incremental_stream(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "1.owl").write_text("SubClassOf(<A> ObjectSomeValuesFrom(<r> <B>))\nSubClassOf(<B> <C>)")
    (docs / "2.owl").write_text("SubClassOf(ObjectSomeValuesFrom(<r> <D>) <E>)")
    (docs / "3.owl").write_text("ObjectPropertyRange(<r> <D>)")
    classifier = IncrementalClassifier(spark)
    found = as_set(facts(classifier.follow(str(docs), str(tmp_path / "checkpoint"))))
    assert {("A", "E"), ("B", "C")} <= found and ("B", "D") not in found and classifier.increment == 3


def test_increments_go_on_after_a_restart(spark, tmp_path):
    docs, state = tmp_path / "docs", str(tmp_path / "state")
    docs.mkdir()
    (docs / "1.owl").write_text("SubClassOf(<A> ObjectSomeValuesFrom(<r> <B>))\nSubClassOf(<B> <C>)")
    first = IncrementalClassifier(spark, path=state)
    first.follow(str(docs))
    # a round of an increment that was cut off: its facts must be found anew and followed
    lost = first.closure
    lost.write(spark.createDataFrame([("A", "E")], "x string, b string"), None)
    (docs / "2.owl").write_text("SubClassOf(ObjectSomeValuesFrom(<r> <C>) <E>)\nSubClassOf(<E> <F>)")
    again = IncrementalClassifier(spark, path=state)
    assert again.increment == 1 and ("A", "E") not in as_set(facts(again.closure))
    found = as_set(facts(again.follow(str(docs))))
    assert {("A", "E"), ("A", "F"), ("B", "C")} <= found and again.increment == 2
    assert as_set(facts(IncrementalClassifier(spark, path=state).follow(str(docs)))) == found


def test_comparison_of_closures(spark):
    s = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "x string, b string")
    wanted = spark.createDataFrame([("a", "b"), ("a", "d"), ("b", "c")], "x string, b string")
    assert as_set(results.missing(s, wanted)) == {("a", "d")} and as_set(results.extra(s, wanted)) == {("a", "c")}
    assert [tuple(r) for r in results.compare(s, wanted).collect()] == [("a", 2, 2, 1, 1)]
    assert results.completeness(s, wanted).first().percent == 75.0
    assert as_set(results.diff_lines(s, wanted)) == {("- a|d",), ("+ a|c",)}
