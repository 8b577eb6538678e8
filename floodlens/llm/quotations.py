"""Chat formatting by quotation linking: replies find the messages they quote.

Messages quote others with `>` before each line, once per level. Each message is taken apart into
passages (lines in a row of one level), and the hash of a quoted passage, after normalising, is
looked up among the passages that messages wrote themselves. The first message that wrote it is
the one quoted; links lead to conversations, whose messages are given without quotes.

DataFrame operations only. A passage that very many messages quote or write is one row of the
lookup, so its replies are not multiplied; conversations stay rows in reply order, however long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.session import staged

_MARKS = r"^((?:[ \t]*>)+)[ \t]?"


def normalized(line: Column) -> Column:
    """A-Z lower-cased, blanks and tabs as single blanks, none at the ends."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[ \t\r]+", " "))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """(msg_id, sent, n, level, line, content) of every line: `level` counts its quote marks,
    `line` is without them, `content` is normalised."""
    lines = messages.select("msg_id", "sent", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    marks = F.regexp_extract("raw", _MARKS, 1)
    line = F.regexp_replace("raw", _MARKS, "")
    return lines.select("msg_id", "sent", "n",
                        F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
                        line.alias("line"), normalized(line).alias("content"))


def passages(lines: DataFrame) -> DataFrame:
    """(msg_id, sent, passage, level, key): maximal runs of lines of one level that are not blank,
    numbered in the order of the message; `key` is the MD5 of the contents."""
    in_order = Window.partitionBy("msg_id").orderBy("n")
    before = F.lag(F.struct("level", F.col("content") == "")).over(in_order)
    begins = ~before.eqNullSafe(F.struct("level", F.lit(False)))
    numbered = (lines.withColumn("begins", begins.cast("int"))
                .withColumn("passage", F.sum("begins").over(in_order))
                .where("content <> ''"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))),
                                     lambda x: x["content"]), "\n")
    return numbered.groupBy("msg_id", "sent", "passage", "level").agg(F.md5(whole).alias("key"))


def parents(found: DataFrame) -> DataFrame:
    """(msg_id, parent_id) of messages that quote an earlier one: the writer of the first passage
    of the lowest quote level that any earlier message wrote."""
    writer = F.struct("sent", "msg_id")
    written = found.where("level = 0").groupBy("key").agg(F.min(writer).alias("writer"))
    nearest = F.min(F.struct("level", "passage", F.col("writer.msg_id").alias("parent_id")))
    return (found.where("level > 0").join(written, "key").where(F.col("writer") < writer)
            .groupBy("msg_id").agg(nearest.alias("nearest"))
            .select("msg_id", "nearest.parent_id"))


def own_texts(lines: DataFrame) -> DataFrame:
    """(msg_id, own_text) of messages that have any: the lines without quote marks, without blank
    lines at the ends."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return lines.where("level = 0").groupBy("msg_id").agg(
        F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "").alias("own_text"))


def threads(replies: DataFrame) -> DataFrame:
    """(msg_id, parent_id, thread_id, depth) of (msg_id, parent_id) without cycles: the message
    without parent that replies lead up to, and the number of steps. Each round doubles the steps
    looked up, for the replies that are not there yet."""
    left = staged(replies.where("parent_id is not null").select(
        "msg_id", F.col("parent_id").alias("top"), F.lit(1).alias("depth")), "threads")
    there: list[DataFrame] = []
    while True:
        further = reduce(DataFrame.unionByName, [*there, left]).select(
            F.col("msg_id").alias("top"), F.col("top").alias("next"),
            F.col("depth").alias("more"))
        looked = staged(left.join(further, "top", "left").select(
            "msg_id", F.coalesce("next", "top").alias("top"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("more").isNotNull().alias("moved")), "threads")
        there.append(looked.where("not moved").drop("moved"))
        left = looked.where("moved").drop("moved")
        if left.isEmpty():
            break
    found = reduce(DataFrame.unionByName, there)
    return replies.join(found, "msg_id", "left").select(
        "msg_id", "parent_id", F.coalesce("top", "msg_id").alias("thread_id"),
        F.coalesce("depth", F.lit(0)).alias("depth"))


def conversations(messages: DataFrame) -> DataFrame:
    """msg_id, sent, parent_id, thread_id, depth, n_quoted (lines), own_text for every message of
    (msg_id, sent, text), `sent` a long. In the order of (thread_id, sent, msg_id) every reply
    follows what it replies to.

    Rows with a null id are left out; a null `sent` counts as 0 and a null text as empty; of rows
    with the same id the one with the smallest (sent, text) counts. A message without quotes, or
    whose quotes nobody wrote before it, starts a conversation. Other columns play no part.
    """
    rows = (messages.where("msg_id is not null")
            .groupBy("msg_id").agg(F.min(F.struct(
                F.coalesce("sent", F.lit(0)).cast("long").alias("sent"),
                F.coalesce("text", F.lit("")).alias("text"))).alias("first"))
            .select("msg_id", "first.sent", "first.text"))
    lines = staged(quoted_lines(rows), "quoted-lines")
    linked = staged(lines.groupBy("msg_id", "sent").agg(
        F.count(F.when(F.col("level") > 0, 1)).alias("n_quoted")).join(
        parents(passages(lines)), "msg_id", "left"), "quoted-links")
    return (linked.select("msg_id", "sent", "n_quoted")
            .join(threads(linked.select("msg_id", "parent_id")), "msg_id")
            .join(own_texts(lines), "msg_id", "left")
            .select("msg_id", "sent", "parent_id", "thread_id", "depth", "n_quoted",
                    F.coalesce("own_text", F.lit("")).alias("own_text")))


def quoting_messages(turns: DataFrame) -> DataFrame:
    """Messages as mail programs write them, from (conv_id, turn, role, text): each quotes the
    first message of the turn before it, and that of the turn before under two marks."""
    order = [F.col(c) for c in ("conv_id", "turn")]
    name = F.concat_ws("-", *[c.cast("string") for c in order], F.substring(
        F.md5(F.concat_ws("|", "role", "text")), 1, 16))
    rows = (turns.where("conv_id is not null and turn is not null")
            .select("conv_id", "turn", "text", name.alias("msg_id")).distinct())
    firsts = rows.groupBy("conv_id", "turn").agg(F.min_by("text", "msg_id").alias("quoted"))

    def before(steps: int, mark: str) -> DataFrame:
        lines = F.concat(F.lit(mark), F.replace("quoted", F.lit("\n"), F.lit("\n" + mark)),
                         F.lit("\n"))
        return firsts.select("conv_id", (F.col("turn") + steps).alias("turn"),
                             lines.alias(f"quote_{steps}"))

    return (rows.join(before(1, "> "), ["conv_id", "turn"], "left")
            .join(before(2, "> > "), ["conv_id", "turn"], "left")
            # Turns are ints: no turn of a conversation is behind one of the next.
            .select("msg_id", (F.col("conv_id") * (1 << 32) + F.col("turn")).alias("sent"),
                    F.concat(F.coalesce("quote_2", F.lit("")), F.coalesce("quote_1", F.lit("")),
                             F.when(F.col("quote_1").isNotNull(), "\n").otherwise(""),
                             F.coalesce("text", F.lit(""))).alias("text")))
