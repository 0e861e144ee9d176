"""The pipeline on the smallest tables: what each stage has to leave, by brute force."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from axiomflow.llm import bpe
from helpers import words


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
        seen.append(now.collect())
    civil, lines, single, clean, encoded = seen
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    # so few labels may not set any term apart; test_filters has the toxic cases
    assert len(civil) <= docs.count() and sum(labels.get(r.doc_id) == 0 for r in civil) >= 0.97 * sum(v == 0 for v in labels.values())
    assert all(list(r.asDict()) == docs.columns for s in seen[:-1] for r in s)
    assert {r.doc_id for r in lines} <= {r.doc_id for r in civil}
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [words(r.text)] for i in range(max(len(w) - 4, 1)) if w} for r in lines}
    kept = [r.doc_id for r in single]
    near = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(near(r.doc_id, k.doc_id) for k in lines if k.doc_id != r.doc_id) for r in lines if r.doc_id not in set(kept))
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in [words(r.text, pattern)] for i in range(len(w) - 9)}
    assert not any(tuple(w[i : i + 10]) in grams for r in clean for w in [words(r.text, pattern)] for i in range(len(w) - 9))
    lib = Tokenizer.from_file(bpe.resolve("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in clean}
    assert len(encoded) == len(clean)
    for r in encoded:
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == lib.encode(texts[r.doc_id], add_special_tokens=False).ids
