"""Operator 4: choose root-to-leaf paths of reply trees and format each as one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: The template: `### role: text</turn>\n` for each turn.
HEAD, COLON, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """Take the control strings out of a text: afterwards each backslash starts one of \\b, \\e, \\h and neither ### nor </turn> is left."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("</turn>"), F.lit("\\e")), F.lit("###"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\e"), F.lit("</turn>")), F.lit("\\h"), F.lit("###")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def best_paths(messages: DataFrame, top: int = 1, max_doublings: int = 40) -> DataFrame:
    """tree, path, depth, id for the messages of the `top` best root-to-leaf paths of each tree.

    messages: tree, id (unique in its tree), parent, score. A null or unknown parent makes a root; messages
    that hang on a circle have no root and are left out. Self-joins double the distance each message looks up
    (1, 2, 4, ...), so a path of n messages takes log2(n) joins, and all messages of a tree stay spread over
    tasks. Branches rank by mean score (null: 0), then by the smaller leaf id.
    """
    m = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    a, b = m.alias("a"), m.select(F.col("tree"), F.col("id")).alias("b")
    joined = a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.parent") == F.col("b.id")), "left")
    up = cut(joined.select("a.tree", "a.id", F.col("b.id").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("a.score").cast("double").alias("total")))
    steps = [up]
    open_now, before = up.where("up IS NOT NULL").count(), None
    # a path that is still open has a message that the last round closed, so a round that closes none leaves circles alone
    while open_now and open_now != before and len(steps) <= max_doublings:
        # messages that have reached a root take no further part in the joins
        a, b = steps[-1].where("up IS NOT NULL").alias("a"), steps[-1].alias("b")
        joined = a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.up") == F.col("b.id")))
        further = joined.select("a.tree", "a.id", F.col("b.up").alias("up"), (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.total") + F.col("b.total")).alias("total"))
        steps.append(cut(steps[-1].where("up IS NULL").unionByName(further)))
        open_now, before = steps[-1].where("up IS NOT NULL").count(), open_now
    ends = steps[-1].where("up IS NULL").drop("up")
    leaves = ends.join(steps[0].select("tree", F.col("up").alias("id")).distinct(), ["tree", "id"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "id")
    path = leaves.withColumn("path", F.row_number().over(order)).where(F.col("path") <= top).select("tree", "path", "id")
    path = cut(path)
    for step in steps[:-1] if len(steps) > 1 else []:
        more = path.join(step.where("up IS NOT NULL").select("tree", "id", "up"), ["tree", "id"]).select("tree", "path", F.col("up").alias("id"))
        path = cut(path.unionByName(more))
    return path.join(ends.select("tree", "id", "depth"), ["tree", "id"]).select("tree", "path", "depth", "id")


def format_paths(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """tree, path, formatted, mask from turns (tree, path, depth, role, text); null role and text are empty.

    mask holds one entry for each turn: start and length of its text (code points, from the start of the turn)
    where the loss counts, null elsewhere.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), escape_role(role), F.lit(COLON))
    span = F.struct(F.char_length("head").alias("start"), F.char_length("body").alias("length"))
    one = turns.select("tree", "path", "depth", role.alias("role"), head.alias("head"), escape(text).alias("body"))
    one = one.select("tree", "path", F.struct("depth", F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("role") == loss_role, span).alias("loss")).alias("t"))
    path = one.groupBy("tree", "path").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return path.select("tree", "path", F.array_join(F.col("t.turn"), "").alias("formatted"), F.col("t.loss").alias("mask"))


def parse_turns(formatted: Column) -> Column:
    """role and text of each turn of a formatted conversation."""
    segment = F.slice(F.split(formatted, END), 1, F.greatest(F.size(F.split(formatted, END)) - 1, F.lit(0)))
    return F.transform(segment, lambda s: F.struct(unescape_role(F.substring_index(F.substr(s, F.lit(len(HEAD) + 1)), COLON, 1)).alias("role"), unescape(F.substr(s, F.locate(COLON, s) + len(COLON))).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """What stands under the mask, unescaped."""
    return F.array_join(F.zip_with(F.split(formatted, END), mask, lambda s, m: F.when(m.isNotNull(), unescape(F.substr(s, m["start"] + 1, m["length"]))).otherwise("")), "")


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, mask, n_messages of linear conversations (conv_id, turn, role, text).

    Each row replies to the row before it in its conversation, by turn (null first), then role and text, so
    repeated turns stay in a fixed order. A row without a conv_id is a conversation by itself, as nothing says
    that it belongs to another (equal ones are one), so that such rows make no group without bound. An empty table
    gives an empty one; other columns are not read.
    """
    alone = F.concat(F.lit("none"), F.xxhash64("turn", "role", "text").cast("string"))
    rows = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), alone).alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("id", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    messages = rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"))
    turns = best_paths(messages).join(rows, ["tree", "id"])
    return format_paths(turns).select(F.when(~F.col("tree").startswith("none"), F.col("tree")).cast("long").alias("conv_id"), "formatted", "mask")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    table = table.unionByName(spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")))
    turns, loss = parse_turns(F.col("formatted")), loss_text(F.col("formatted"), F.col("mask"))
    read = chat_format(table).select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h')) AS t,
    length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c')) AS r FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(t + r + 14) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
