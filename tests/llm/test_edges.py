"""Each registered text query and the pipeline on tables of odd rows, and on empty ones."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, n_words string, __hx_own string, __own_0 string",
    "labels": "doc_id bigint, quality int, toxic int, text string",
    "benchmark": "item_id bigint, text string, n_hit string",
    "pages": "page_id bigint, url string, html string, main_text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string, formatted string",
}
NAMES = [n for n in entry.queries() if n.startswith("op")]


def odd_rows():
    plain = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing"
    own = [" ".join(f"{a}{b}{i}" for a in "klmnop" for b in "qrstu") for i in range(20)]
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    texts = [*own, None, "", "  \n\t", plain, plain, "a" * 100_000, long, "word " * 30_000, "\n".join(["same line"] * 5000)]
    documents = [(i, t, None, "x" if i % 2 else None, None if t is None else len(t), 0.5, "n", "w", "h", "o") for i, t in enumerate(texts)]
    documents += [documents[0], (None, "no id here", None, None, None, None, None, None, None, None), (3, "another text under the id of the fourth one", "l", "s", 1, 1.0, "n", "w", "h", "o")]
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>{}</p></article></body></html>"
    return {
        "documents": documents,
        "labels": [(i, 1, int(i % 3 == 0), "t") for i in range(28)] + [(None, None, 1, None), (2, None, None, "t"), (999, 1, 1, "t")],
        "benchmark": [(1, plain, "x"), (None, "one two", "x"), (2, None, "x"), (3, "", "x"), (1, long, "x")],
        "pages": [(i, u, h, "m") for i, (u, h) in enumerate([("http://a.b/1", page.format(plain)), (None, page.format(long)), ("http://a.b/2", None), ("", ""), ("no url", "<p>" * 5000)])] + [(0, "http://a.b/1", page.format(plain), "m")],
        "conversations": [(1, 0, "user", "a", "f"), (1, 0, "user", "a", "f"), (1, None, None, None, None), (None, 1, "assistant", long, "f"), (2, 0, "assistant", "", "f")],
    }


def written(spark, folder, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("odd"), odd_rows())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    rows = odd_rows()
    got = entry.queries()[name](spark, odd).collect()
    if name.startswith("op1_"):
        assert {r.conv_id: r.n_turns for r in got} == {1: 3, None: 1, 2: 1, -7: 2}
    else:
        key, source = ("page_id", "pages") if name.startswith("op7_") else ("doc_id", "documents")
        order = lambda i: (i is not None, i or 0)
        assert sorted((r[key] for r in got), key=order) == sorted((r[0] for r in rows[source]), key=order)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert entry.queries()[name](spark, empty).count() == (1 if name.startswith("op1_") else 0)


def test_pipeline_of_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    now, own = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, odd)
        assert now.columns == own and now.dtypes == docs.dtypes, name
    # texts of no words are never near copies, so the null and the blank ones stay; one of the two plain ones does
    texts = {r.doc_id: r.text for r in now.collect()}
    kept = {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()}
    assert kept == set(texts) and {20, 21, 22} <= kept and 24 not in kept
    assert texts[20] in (None, "")


def test_pipeline_of_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
