"""Exact and near duplicates, components, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from axiomflow.llm import exact_dedup, minhash
from axiomflow.llm.components import connected_components

from helpers import words


def brute_components(edges, nodes=()):
    root = {n: n for n in nodes}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(25)], [(0, i) for i in range(1, 30)], [(random.Random(4).randrange(60), random.Random(i).randrange(60)) for i in range(40)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, *edges[:2]], "u bigint, v bigint")).collect()}
    assert got == {x: r for x, r in brute_components(e for e in edges if e[0] != e[1]).items() if x != r}


def corpus():
    """Copies, near copies around the limit, chains of near copies, hot groups, odd rows."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice([3, 5, 6, 9, 40, 120]))
        now = list(base)
        for c in range(rnd.choice([1, 3, 30])):
            rows.append(" ".join(now))
            if g % 3:
                now = list(base) if g % 2 else now
                for _ in range(rnd.choice([0, 1, 2])):
                    now[rnd.randrange(len(now))] = rnd.choice(vocabulary)
    rows += [None, "", " \n", "One two THREE", "one two three", "one  two\tthree", rows[0]]
    return list(enumerate(rows)) + [(0, rows[0]), (4, "another text under the id of the fourth one")]


def brute_near(rows, percent=75):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    comps = brute_components(links, range(len(rows)))
    least = {}
    for i, c in comps.items():
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[comps[i]], rows[i][0] == least[comps[i]]) for i in range(len(rows)))


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, node string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df).collect())
    assert got == brute_near(rows)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in got if r[3]}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_a_group_around_the_limit_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP_PAIRS", 5)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(260):  # each with words of its own; some share their changes, some are copies, some hold only half
        now = list(base)
        for k in range(rnd.choice([2, 3, 4, 5, 6])):
            now[rnd.randrange(150)] = f"own{i}x{k}" if rnd.random() < 0.7 else f"shared{rnd.randrange(4)}"
        texts.append(" ".join(now[: 75 if i % 17 == 0 else 150]))
    rows = list(enumerate([*texts, texts[5], texts[5].upper()]))
    want = brute_near(rows)
    assert 20 < len({r[2] for r in want}) < 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(df).collect()) == want


def test_words_of_any_length_and_place(monkeypatch):
    rnd = random.Random(4)
    parts = ["x" * rnd.randrange(1, 60) + str(i % 7) for i in range(300)]
    text = "".join(w + rnd.choice([" ", "\n", "  \t"]) for w in parts).encode()
    want = [minhash.word_hashes(w.encode())[0] for w in parts]
    assert minhash.word_hashes(text).tolist() == want and len(set(want)) == len(set(parts))
    monkeypatch.setattr(minhash, "PIECE", 32)
    same = [minhash.word_hashes(w.encode())[0] for w in parts]
    assert minhash.word_hashes(text).tolist() == same and minhash.word_hashes(b"  " * 50 + text).tolist() == same
    assert minhash.word_hashes(b" " * 100).tolist() == [] == minhash.word_hashes(b"").tolist()


def brute_exact(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault("".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(text or ""), doc))
    out = []
    for g in groups.values():
        out += [(doc, min(g)[1], len(g), (n, doc) == min(g)) for n, doc in g]
    return sorted(out)


def test_exact_equals_brute_force(spark, tmp_path, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["ab c", "a bc", "abc", "a\nb  c", "xyz", "Xyz", "", " ", None, "é", "long " * 5000])) for i in range(80)] + [(3, "abc"), (90, "once")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, keep_id string")
    df.repartition(3).write.parquet(str(tmp_path / "docs.parquet"))
    take = lambda out: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect())
    assert take(exact_dedup.exact_dedup(spark, str(tmp_path / "docs.parquet"))) == brute_exact(rows)
    # digests that clash: full bytes decide
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.unhex(F.lit("00")))
    assert take(exact_dedup.exact_dedup(spark, str(tmp_path / "docs.parquet"))) == brute_exact(rows)


def test_exact_goes_on_from_its_state(spark, tmp_path):
    path, state = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string").write.parquet(path)
    assert exact_dedup.exact_dedup(spark, path, checkpoint=state).count() == 2
    spark.createDataFrame([(3, "a  b"), (4, "d")], "doc_id bigint, text string").write.mode("append").parquet(path)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, path, checkpoint=state).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_exact_starts_no_processes_for_state_files(spark, tmp_path):
    jvm, path, log = spark._jvm, str(tmp_path / "docs.parquet"), str(tmp_path / "starts.jfr")
    spark.createDataFrame([(i, f"a{i % 3}") for i in range(9)], "doc_id bigint, text string").write.parquet(path)
    seen = jvm.jdk.jfr.Recording()
    seen.enable("jdk.ProcessStart")
    seen.start()
    assert exact_dedup.exact_dedup(spark, path).count() == 9
    seen.stop()
    seen.dump(jvm.java.nio.file.Path.of(log, spark.sparkContext._gateway.new_array(jvm.String, 0)))
    seen.close()
    starts = [e.getString("command").split()[0] for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(jvm.java.io.File(log).toPath())]
    assert starts.count("chmod") and not starts.count("readlink")


def test_exact_opens_few_stores_for_a_small_input(spark, tmp_path, monkeypatch):
    path, cores = str(tmp_path / "docs.parquet"), spark.sparkContext.defaultParallelism
    rows = [(i, f"a{i % 50}") for i in range(90)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    monkeypatch.setattr(exact_dedup, "fresh_path", lambda spark, label: str(tmp_path / label))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(2 * cores))
    try:
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, path).collect()) == brute_exact(rows)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(2 * cores)
        assert len([p for p in (tmp_path / "exact-dedup/state/state/0").iterdir() if p.name.isdigit()]) == cores
        monkeypatch.setattr(exact_dedup, "STATE_BYTES", 1)
        assert exact_dedup.state_partitions(spark, path) == 2 * cores == exact_dedup.state_partitions(spark, str(tmp_path / "doc*.parquet"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exact_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "none.parquet"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "none.parquet")).count() == 0


def test_signatures_of_unrelated_long_texts_disagree(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(str(rnd.randrange(10**6)) for _ in range(2000))) for i in range(6)]
    sigs = [bytes(r.sig) for r in minhash.signatures(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()]
    for i, a in enumerate(sigs):
        for b in sigs[:i]:
            assert sum(x == y for x, y in zip(a, b, strict=True)) < minhash.AGREEING * minhash.HASHES / 4
