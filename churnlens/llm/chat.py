r"""Relational formatting of conversations, in Spark expressions only.

A conversation's turns are collected as structs and sorted.  Neighbouring turns
of one role become one block by array expressions; a block is

    ### <role>:\n<text>[<next><text> ...]</turn>\n

``<next>`` parts the texts of a block, so that merging loses no turn.  Inside a
text the control strings are broken by a backslash (``###`` -> ``#\##``,
``</turn>`` -> ``<\/turn>``, ``<next>`` -> ``<\next>``) and a backslash is doubled,
so a control string in the output is always a mark and dropping each escaping
backslash gives the text back.  A role is percent-encoded.  The loss mask is an
array of (start, length) spans in code points of the output, one per assistant
text, marks left out.

Turns stand by turn number (null first), then role and text, so repeated and
tied rows have one order and all are kept; a null text or role is empty; rows
without a conv_id are one conversation; texts of any length are formatted whole;
other columns are ignored; an empty table has no conversations.  A conversation
is one string, so it must fit a row; its rows meet in one task for that reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import let

HEAD, NEXT, END = "### ", "<next>", "</turn>\n"
CHUNK = 512


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, "#(?=##)", r"#\\")
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(NEXT), F.lit("<\\next>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def running(lengths: Column) -> Column:
    """Sum of the earlier elements at each element, in chunks, so that no step
    copies more than a chunk or the list of chunks."""
    def sums(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b)

    def of_chunks(chunks: Column) -> Column:
        first = sums(F.transform(chunks, total), F.lit(0).cast("bigint"))
        both = F.zip_with(chunks, first, lambda c, s: F.struct(c.alias("c"), s.alias("s")))
        return F.flatten(F.transform(both, lambda b: sums(b["c"], b["s"])))

    def cut(values: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(values)), lambda i: (i % CHUNK == 0) & (i < F.size(values)))
        return F.transform(starts, lambda i: F.slice(values, i + 1, F.lit(CHUNK)))
    return let(lengths, lambda v: let(cut(v), of_chunks))


def format_chats(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): one string a conversation, and the spans of
    the texts of role ``trained`` in it."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def neighbours(t: Column) -> Column:
        """(role, text, opens, closes): whether a turn begins or ends a block of its role."""
        roles = F.transform(t, lambda x: x["role"])
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, F.lit(1), F.size(t) - 1))
        after = F.concat(F.slice(roles, F.lit(2), F.size(t)), F.array(F.lit(None).cast("string")))
        return F.transform(F.arrays_zip(t.alias("x"), before.alias("b"), after.alias("a")), lambda z: F.struct(
            z["x"]["role"].alias("role"), z["x"]["text"].alias("text"),
            (~z["b"].eqNullSafe(z["x"]["role"])).alias("opens"), (~z["a"].eqNullSafe(z["x"]["role"])).alias("closes")))

    def piece(x: Column) -> Column:
        lead = F.when(x["opens"], F.concat(F.lit(HEAD), F.url_encode(x["role"]), F.lit(":\n"))).otherwise(F.lit(NEXT))
        return F.struct(lead.alias("lead"), escape(x["text"]).alias("body"), F.when(x["closes"], F.lit(END)).otherwise(F.lit("")).alias("tail"),
                        (x["role"] == trained).alias("loss"))

    def assembled(p: Column) -> Column:
        size = F.transform(p, lambda x: (F.length(x["lead"]) + F.length(x["body"]) + F.length(x["tail"])).cast("bigint"))
        placed = F.zip_with(p, running(size), lambda x, at: F.struct(x.alias("x"), at.alias("at")))
        spans = F.transform(F.filter(placed, lambda z: z["x"]["loss"]), lambda z: F.struct(
            (z["at"] + F.length(z["x"]["lead"])).alias("start"), F.length(z["x"]["body"]).cast("bigint").alias("length")))
        return F.struct(F.array_join(F.transform(p, lambda x: F.concat(x["lead"], x["body"], x["tail"])), "").alias("formatted"),
                        spans.alias("loss"))
    out = let(let(F.col("t"), neighbours), lambda n: let(F.transform(n, piece), assembled))
    return chats.select("conv_id", out.alias("o")).select("conv_id", "o.formatted", "o.loss")


def read_turns(formatted: Column) -> Column:
    """The turns, (role, text), of a formatted conversation."""
    def block(b: Column) -> Column:
        return let(F.instr(b, "\n"), lambda at: let(
            F.url_decode(F.substring(b, F.lit(len(HEAD) + 1), at - len(HEAD) - 2)),
            lambda role: F.transform(F.split(F.substring(b, at + 1, F.length(b)), NEXT),
                                     lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))))
    return let(F.split(formatted, END), lambda bs: F.flatten(F.transform(F.slice(bs, F.lit(1), F.size(bs) - 1), block)))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    turns = let(read_turns(F.col("formatted")), lambda t: F.struct(
        F.size(t).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256)
        .alias("turns_sha256")))
    under = let(F.array_join(read_loss(F.col("formatted"), F.col("loss")), ""), lambda s: F.struct(
        F.length(s).cast("long").alias("loss_chars"), F.sha2(s.cast("binary"), 256).alias("loss_sha256")))
    return chats.select("conv_id", turns.alias("t"), under.alias("u"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "t.n_turns", "t.turns_sha256", "u.loss_chars", "u.loss_sha256", "formatted_chars")
