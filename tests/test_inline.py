"""Inline ids, and saturation on them: the same facts as on IRIs, without a dictionary and without files left behind."""

from axiomflow.operators import dictionary, normalize
from axiomflow.plans.saturate import facts, saturate
from axiomflow.schema import BOTTOM, TOP, Axioms, frame

ODD = ["a", "a0", "a00", "a7", "a07", "a10", "7", "007", "", "GO:0001234", "n999999999999", "n1000000000000", "n01000000000000", "é5", "x5y", "x" * 300 + "12"]


def as_set(df):
    return {tuple(r) for r in df.collect()}


def left(spark):
    """Shuffle files that lie on the driver's disk."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")]


def test_odd_names_come_back(spark):
    found = dictionary.inline(Axioms.of(spark, sub=frame(spark, [(x, x + "1") for x in ODD], "a string, b string")))
    ids = [r.a for r in found.axioms.sub.collect()]
    assert len(set(ids)) == len(ODD)
    assert as_set(found.decode(found.axioms.sub, ["a", "b"])) == {(x, x + "1") for x in ODD}
    assert found.ids([BOTTOM, TOP]) == [found.nothing, found.top]


def test_too_many_stems_use_a_dictionary(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", 3)
    known = dictionary.identified(Axioms.from_lists(spark, sub=[("Aa", "Bb"), ("Bb", "Cc"), ("Cc", "Dd")]))
    assert isinstance(known, dictionary.Looked)
    closure = saturate(known.axioms, nothing=known.nothing, top=known.top, ready_made=True)
    found = as_set(known.decode(facts(closure, known.nothing, known.top), ["x", "b"]))
    assert found == {(x, b) for x, b in [("Aa", "Bb"), ("Aa", "Cc"), ("Aa", "Dd"), ("Bb", "Cc"), ("Bb", "Dd"), ("Cc", "Dd")]}


def test_same_facts_as_on_iris_and_no_files_left(spark):
    ax = Axioms.from_lists(
        spark, sub=[("o:1", "s:F"), ("p:1", "B#13"), ("B#13", "Thing"), ("p:1", BOTTOM)], ex=[("o:1", "has", "p:1"), ("o:1", "has", "p:2"), ("s:F", "r", "n:1")], role=[("has", "rel"), ("rel", "any")],
        chain=[("has", "in", "from")], exl=[("rel", "Thing", "Hot")], conj=[(("Hot", "s:F"), "Both")], dom=[("has", "Doc")], rng=[("has", "Item")],
    )
    plain = saturate(normalize.eliminate_ranges(ax))
    known = dictionary.identified(ax.with_(sub=ax.sub.repartition(3), ex=ax.ex.repartition(3)))
    before = set(left(spark))
    closure = saturate(known.axioms, nothing=known.nothing, top=known.top, ready_made=True)
    stay = set(left(spark)) - before
    assert as_set(known.decode(facts(closure, known.nothing, known.top), ["x", "b"])) == as_set(facts(plain))
    assert as_set(known.decode(closure.r.select("r", "x", "y"), ["r", "x", "y"])) == as_set(plain.r.select("r", "x", "y"))
    assert sum(name.endswith(".data") for name in stay) <= 12  # those of a few small looks at axioms, none of a round
