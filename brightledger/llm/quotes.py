"""Quotation linking: reply trees from quoted passages, in DataFrame functions.

A line's quote level is the number of `>` it begins with. Neighbouring lines of
one level are a passage. Passages, their paragraphs and their lines are
normalised and hashed; those of level 0 are a message's own, and the earliest
message of a conversation that has one is its original. Quoted ones are joined
with originals by conversation and hash, and the longest match of a passage
tells its original; a message answers the latest one that it quotes at level 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.llm.ranks import ranked
from brightledger.llm.tables import settled

_MARK = r"^(?:>[ \t]?)*"
_APART = "\x00"


def _lines(text: Column) -> Column:
    """(level, body) of each line; a `\\r` before the line's end is dropped."""
    return F.transform(
        F.split(F.translate(text, _APART + "\r", ""), "\n"),
        lambda line: F.struct(
            F.length(F.translate(F.regexp_extract(line, _MARK, 0), " \t", "")).alias("level"),
            F.regexp_replace(line, _MARK, "").alias("body"),
        ),
    )


def _passages(lines: Column, level: Column | int) -> Column:
    """The texts of all passages of one level."""
    joined = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["body"]).otherwise(F.lit(_APART))), "\n")
    return F.filter(F.transform(F.split(joined, _APART), lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), lambda p: F.trim(p) != "")


def normal(passage: Column) -> Column:
    """A-Z in lower case, white space as single blanks, none at the ends."""
    low = F.translate(passage, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[ \t\n\x0b\f\r]+", " "))


def _units(passage: Column) -> Column:
    """(size, hash) of a passage, its paragraphs and its lines, the passage first."""
    parts = F.flatten(F.array(F.array(passage), F.split(passage, r"\n\s*\n"), F.split(passage, "\n")))
    normals = F.array_distinct(F.filter(F.transform(parts, normal), lambda u: u != ""))
    return F.transform(normals, lambda u: F.struct(F.length(u).alias("size"), F.sha2(u, 256).alias("hash")))


def link_quotes(messages: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), parent_turn, depth,
    root_turn, n_quotes, n_linked, reply_order of each message; one row for each
    input row.

    `reply_order` numbers the messages of a conversation from 0 so that each
    follows what it answers, earlier answers first; sort by conv_id and
    reply_order to write conversations. A message that quotes nothing known is a root. n_quotes
    counts quoted passages of all levels, n_linked those of which the whole, a
    paragraph or a line has an original of an earlier turn. Null texts are empty; messages without conversation or turn
    are roots and link nothing. Rows that share conversation and turn are one
    message in the tree and keep their own texts. Texts are equal if the
    SHA-256 values of their normal forms are.
    """
    c = F.col
    rows = messages.select(
        c(conv_column).alias("conv_id"), c(turn_column).cast("long").alias("turn"), c(role_column).alias("role"), _lines(F.coalesce(c(text_column), F.lit(""))).alias("lines")
    )
    deepest = F.array_max(F.transform("lines", lambda x: x["level"]))
    levels = F.when(deepest > 0, F.sequence(F.lit(1), deepest)).otherwise(F.array().cast("array<int>"))
    quoted = F.flatten(F.transform(levels, lambda k: F.transform(_passages(c("lines"), k), lambda p: F.struct(k.alias("level"), _units(p).alias("units")))))
    own = _passages(c("lines"), 0)
    cut = rows.select("conv_id", "turn", "role", F.array_join(own, "\n").alias("text"), F.array_distinct(F.flatten(F.transform(own, lambda p: F.transform(_units(p), lambda u: u["hash"])))).alias("own"), quoted.alias("quoted"))
    cut = settled(cut, "passages")
    originals = settled(cut.select("conv_id", "turn", F.explode("own").alias("hash")).where("turn is not null").groupBy("conv_id", "hash").agg(F.min("turn").alias("original")), "originals")
    quotes = cut.select("conv_id", "turn", F.posexplode("quoted").alias("place", "q")).select("conv_id", "turn", "place", "q.level", F.get("q.units", F.lit(0))["hash"].alias("whole"), F.explode("q.units").alias("u"))
    found = quotes.select("conv_id", "turn", "place", "level", "whole", "u.size", "u.hash").join(originals, ["conv_id", "hash"]).where("original < turn")
    # The longest match of each passage; of equally long ones the latest.
    linked = found.groupBy("conv_id", "turn", "place", "whole").agg(F.first("level").alias("level"), F.max(F.struct("size", "original"))["original"].alias("original"))
    parents = linked.groupBy("conv_id", "turn").agg(F.max(F.when(c("level") == 1, c("original"))).alias("parent_turn"), F.count(F.lit(1)).alias("n_linked"))
    nodes = cut.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct().join(parents, ["conv_id", "turn"], "left")
    placed = _ordered(settled(nodes.select("conv_id", "turn", "parent_turn", "n_linked"), "nodes"))
    none = F.lit(0).cast("long")
    return cut.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "parent_turn", F.coalesce("depth", none).alias("depth"), F.coalesce("root_turn", "turn").alias("root_turn"),
        F.size("quoted").cast("long").alias("n_quotes"), F.coalesce("n_linked", none).cast("long").alias("n_linked"), F.coalesce("reply_order", none).alias("reply_order"),
    )


def _followed(links: DataFrame) -> DataFrame:
    """(conv_id, turn, end, steps): where following `next` from each message
    ends, and after how many steps. Each round joins what has not ended with
    what it points to, so steps double: a chain of n takes log n rounds. A row
    has a fixed size, however long its chain."""
    rows = settled(links.select("conv_id", "turn", "next", F.col("turn").alias("end"), F.lit(0).cast("long").alias("steps")), "links")
    while rows.where("next is not null").limit(1).count():
        ahead = rows.select("conv_id", F.col("turn").alias("next"), F.col("next").alias("further"), F.col("end").alias("new_end"), F.col("steps").alias("more"))
        moved = rows.where("next is not null").join(ahead, ["conv_id", "next"])
        moved = moved.select("conv_id", "turn", F.col("further").alias("next"), F.col("new_end").alias("end"), (F.col("steps") + 1 + F.col("more")).alias("steps"))
        rows = settled(rows.where("next is null").unionByName(moved), "links")
    return rows.drop("next")


def _ordered(nodes: DataFrame) -> DataFrame:
    """The nodes with depth, root_turn and reply_order.

    A message comes right after its parent if it is the first answer, else after
    the last message below the answer before it. The last one below is found by
    following last answers; how many messages come before, by following these
    predecessors. Answers of one message are numbered by ranges, so a message
    with any number of them is no single task.
    """
    c, keys = F.col, ["conv_id", "turn"]
    roots = _followed(nodes.select(*keys, c("parent_turn").alias("next"))).select(*keys, c("end").alias("root_turn"), c("steps").alias("depth"))
    newest = nodes.where("parent_turn is not null").groupBy("conv_id", c("parent_turn").alias("turn")).agg(F.max("turn").alias("next"))
    ends = _followed(nodes.select(*keys).join(newest, keys, "left")).select("conv_id", c("turn").alias("before"), c("end").alias("last"))
    family = F.concat(c("conv_id").cast("string"), F.lit(":"), F.coalesce(c("parent_turn").cast("string"), F.lit("")))
    answers = ranked(nodes.select(*keys, "parent_turn", family.alias("family")), "family", ["turn"], "answers")
    earlier = answers.select("family", (c("place") + 1).alias("place"), c("turn").alias("before"))
    before = answers.join(earlier, ["family", "place"], "left").join(ends, ["conv_id", "before"], "left")
    numbered = _followed(before.select(*keys, F.coalesce("last", "parent_turn").alias("next"))).select(*keys, c("steps").alias("reply_order"))
    return nodes.join(roots, keys).join(numbered, keys)
