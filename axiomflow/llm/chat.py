"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (text, image, audio, document). A visitor flattens the parts in order: text is
escaped, other kinds become placeholders, whose reference and expanded token count are recorded as attachments.
``<|turn|>role<|body|>content<|end|>`` marks a turn. A control string inside a text gets a backslash after its first
character, and one more if it has some there already, so that unescaping takes exactly one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: First character, backslashes, and what makes a control string of it: <|...|>, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
REST = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
ESCAPE = r"([<\[])(\\*)" + REST
UNESCAPE = r"([<\[])\\(\\*)" + REST
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"
#: Tokens that a placeholder stands for where its part names no number.
EXPANDED = {"image": 256, "audio": 128, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def text_part(text: Column) -> Column:
    """A content of one text part; a null text is an empty one."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def _by_kind(kind: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for name, value in cases.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, ``formatted``, ``n_turns``, ``loss_spans``, ``attachments``, ``attachment_tokens``.

    Turns are ordered by (turn, role, content); ties and repeated rows all stay, a null turn comes first, a null
    role is empty. Null conversations form one of their own. Null or empty parts give an empty body; a part of
    an unknown kind is visited as text. ``loss_spans``: array of (turn: 1-based place, start: 0-based code point in
    that turn's marked-up string, length), one for each turn of ``loss_role``. ``attachments``: array of (turn,
    ordinal among its attachments, kind, ref, tokens). Other columns of df are left out. One conversation becomes one
    string, so all its rows meet in one task; rows are reduced to the marked-up turn before they are sent there.
    """
    content = F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    who = F.coalesce(F.col(role), F.lit(""))

    def visit(p: Column) -> Column:
        return _by_kind(p["kind"], {k: F.lit(f"<|{k}|>") for k in EXPANDED}, escape(F.coalesce(p["text"], F.lit(""))))

    def attachment(p: Column, i: Column) -> Column:
        default = _by_kind(p["kind"], {k: F.lit(n) for k, n in EXPANDED.items()}, F.lit(0))
        return F.struct((i + 1).alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], default.cast("bigint")).alias("tokens"))

    body = F.array_join(F.transform(F.filter(content, lambda p: p.isNotNull()), visit), "")
    attached = F.transform(F.filter(content, lambda p: p["kind"].isin(*EXPANDED)), attachment)
    head = F.concat(F.lit(TURN), escape(who), F.lit(BODY))
    turns = df.select(
        F.col(conv).alias(conv), F.col(turn).alias("__turn"), who.alias("__role"), F.concat(head, body, F.lit(END)).alias("__marked"),
        F.when(F.col(role) == loss_role, F.struct(F.length(head).alias("start"), F.length(body).alias("length"))).alias("__loss"), attached.alias("__attached"),
    )
    grouped = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("__turn", "__role", "__marked", "__loss", "__attached"))).alias("t"))
    spans = F.filter(
        F.transform("t", lambda x, i: F.struct((i + 1).alias("turn"), x["__loss"]["start"].alias("start"), x["__loss"]["length"].alias("length"))),
        lambda s: s["start"].isNotNull(),
    )
    refs = F.flatten(F.transform("t", lambda x, i: F.transform(x["__attached"], lambda a: F.struct((i + 1).alias("turn"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = grouped.select(conv, F.array_join(F.transform("t", lambda x: x["__marked"]), "").alias("formatted"), F.size("t").cast("bigint").alias("n_turns"), spans.alias("loss_spans"), refs.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def marked_turns(formatted: Column) -> Column:
    """The marked-up turns of a formatted conversation."""
    return F.filter(F.split(formatted, r"(?=<\|turn\|>)"), lambda s: s != "")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation; placeholders stay as they are."""
    shape = r"(?s)^<\|turn\|>(.*?)<\|body\|>(.*)<\|end\|>$"
    return F.transform(marked_turns(formatted), lambda s: F.struct(unescape(F.regexp_extract(s, shape, 1)).alias("role"), unescape(F.regexp_extract(s, shape, 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    marked = marked_turns(formatted)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.element_at(marked, s["turn"]), s["start"] + 1, s["length"]))), "")
