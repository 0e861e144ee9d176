"""BPE and prefix counts against the vocabularies' own library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from axiomflow.llm import bpe, tokencount


@pytest.fixture(scope="module")
def libraries():
    return {f: Tokenizer.from_file(bpe.resolve(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encode_and_decode(spark, docs, libraries, vocabulary):
    lib = libraries[vocabulary]
    out = bpe.encode_text(docs, "text", vocabulary, decoded=True)
    assert out.columns == ["doc_id", "text", "score", "token_ids", "n_tokens", "decoded_text"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_text == lib.decode(ids, skip_special_tokens=False)
    again = bpe.decode_ids(out, "token_ids", vocabulary).collect()
    assert [r.decoded_text for r in again] == [r.decoded_text for r in rows]


def test_counts(spark, docs, libraries):
    lib = libraries["byte_bpe_50k.json"]
    for r in tokencount.count_tokens(docs).collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)


def test_prefix_table_answers(texts, libraries):
    lib, counter = libraries["byte_bpe_50k.json"], tokencount.counter("byte_bpe_50k.json")
    for text in (t[:160] for t in texts if t):
        store = tokencount.PrefixStore(counter.model, text, *counter.table(text))
        exact = [len(lib.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        cut = text.find("<|")
        for n in range(len(text) + 1):
            if cut < 0 or n <= cut:
                assert store.tokens(n) == exact[n]
        for budget in (0, 1, 5, exact[-1]):
            assert store.tokens(store.longest_within(budget)) <= budget or cut >= 0


def test_empty_table(spark, docs):
    assert bpe.encode_text(docs.limit(0)).count() == 0 and tokencount.count_tokens(docs.limit(0)).count() == 0


def test_bounded_cache():
    from axiomflow.llm.common import ByteCache

    made = []
    cache = ByteCache(2 * 10 * (ByteCache.ENTRY + 2), lambda k: made.append(k) or k * 2, longest=4)
    for _ in range(3):
        for i in range(30):
            assert cache[f"{i:02}"] == f"{i:02}" * 2
        assert cache["00"] == "0000" and len(cache) <= 11 and len(cache.old) <= 11
    long = len(made)
    assert cache["abcde"] == cache["abcde"] and len(made) == long + 2 and "abcde" not in cache


def test_longest_prefix_within_a_budget(libraries):
    lib, counter = libraries["byte_bpe_50k.json"], tokencount.counter("byte_bpe_50k.json")
    for text in ("Wednesdayish", "It was Wednesdayish  weather, wasn't it?  Unbelievably so", " \n\n  x 日本語 they've"):
        store = tokencount.PrefixStore(counter.model, text, *counter.table(text))
        exact = [len(lib.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        for budget in range(exact[-1] + 1):
            assert store.longest_within(budget) == max(n for n, c in enumerate(exact) if c <= budget)


def test_each_prefix_of_odd_texts(libraries):
    lib, counter, rnd = libraries["byte_bpe_50k.json"], tokencount.counter("byte_bpe_50k.json"), random.Random(12)
    bits = ["a", "'", "ve", "'ll", "'re", " ", "  ", "\n", "\t", "<|endoftext|>", "<|", "12", "é", "日本", "!?", "word", "\x1c", "　", "s"]
    for _ in range(400):
        text = "".join(rnd.choices(bits, k=rnd.randrange(12)))
        (table,) = counter.table(text)
        assert table.tolist() == [len(lib.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]


def test_stored_tables_answer_in_sql(spark, docs, libraries):
    lib = libraries["byte_bpe_50k.json"]
    out = tokencount.count_tokens(docs.withColumn("fits_chars", F.lit("x")), limit=7, table=True)
    out = out.withColumn("ten", tokencount.tokens_of_prefix(F.col("prefix_tokens"), 10)).withColumn("fits", tokencount.longest_prefix(F.col("prefix_tokens"), 7))
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r.text or ""
        assert r.ten == len(lib.encode(text[:10], add_special_tokens=False).ids) and len(r.prefix_tokens) == len(text) + 1 and r.fits == r.fits_chars
        assert r.fits == max(n for n, c in enumerate(r.prefix_tokens) if c <= 7)


def test_fit_is_what_the_table_says():
    counter, rnd = tokencount.counter("byte_bpe_50k.json"), random.Random(14)
    bits = ["a", "'", "ve", " 'll", " ", "  ", "\n", " <|endoftext|>", "12", "é", " wordish", "!?", " Wednesdayish"]
    for _ in range(300):
        text = "".join(rnd.choices(bits, k=rnd.randrange(25)))
        store = tokencount.PrefixStore(counter.model, text, *counter.table(text))
        for budget in (0, 1, 2, 3, 5, 8, 13, 40):
            assert counter.fit(text, budget) == (store.tokens(len(text)), store.longest_within(budget))
