"""Chat formatting: round trips, parts, masks."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axiomflow.llm import chat

BITS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|body|>", "<|end|>", "<|", "\\", "<\\", "[\\/INST]", "a", "\n", "é"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=8).map("".join), min_size=1, max_size=60))
def test_round_trip(spark, texts):
    rows = [(i // 4, i % 4, ["user", "assistant", t, None][i % 4], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chat(df.withColumn("parts", chat.text_part(F.col("text"))))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    for r in out.collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3]) for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant") and r.n_turns == len(own)


def test_parts_and_ties(spark):
    part = "kind string, text string, ref string, tokens bigint"
    rows = [
        (1, 0, "user", [("text", "see ", None, None), ("image", None, "s3://a.png", None), ("audio", None, "b.wav", 7), ("text", None, None, None), ("odd", "<|end|>", None, None)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None)]),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<struct<{part.replace(' ', ':').replace(',:', ', ')}>>")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    one = got[1]
    assert one.formatted == "<|turn|>user<|body|>see <|image|><|audio|><\\|end|><|end|>" + 2 * "<|turn|>assistant<|body|><|document|><|end|>"
    assert [(a.turn, a.ordinal, a.kind, a.ref, a.tokens) for a in one.attachments] == [(1, 1, "image", "s3://a.png", 256), (1, 2, "audio", "b.wav", 7), (2, 1, "document", "c.pdf", 512), (3, 1, "document", "c.pdf", 512)]
    assert one.attachment_tokens == 256 + 7 + 1024 and got[None].formatted == "<|turn|><|body|><|end|>"
    assert chat.format_chat(df.limit(0)).count() == 0
