"""Chat formatting: reply trees to conversations, by DataFrame operations only.

Self-joins that double their reach give each leaf the mean score of its path, by which a tree's branches are ranked; the same jumps
then list the nodes of the chosen paths: after k rounds a leaf has its 2 ** k nearest ancestors. A chosen path becomes one text:

    <s><|role|>text</s><|role|>text</s>...

Inside texts and roles `&`, `<` and `[` become `&amp;`, `&lt;` and `&#91;` (in roles also `|`, `&#124;`), so that no control string of
this or the common bracket templates can occur there, and unescaping gives each text back. Spans of the loss mask are kept as
(start, length) in code points of the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BEGIN, HEAD, HEAD_END, END = "<s>", "<|", "|>", "</s>"
LEARNED_ROLE = "assistant"
_MARKS = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
_BAR = ("|", "&#124;")


def escape(text: Column, role: bool = False) -> Column:
    """Without control strings; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, coded in (*_MARKS, *([_BAR] if role else [])):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    for plain, coded in (_BAR, *reversed(_MARKS)):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _up(at: str) -> Column:
    """The condition that `at` of a row is the node (_t, _n) of another."""
    return F.col("tree").eqNullSafe(F.col("_t")) & (F.col(at) == F.col("_n"))


def tree_paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, node, dist) for every node on the `branches` best root-to-leaf paths (all for None) of each tree of nodes (tree, node, parent, score); dist is 0 at the leaf.

    A path's score is the mean of its nodes' scores, null as 0; ties go to the lower leaf. A node without a parent in its tree is a
    root. Null trees are a tree; null nodes have no place in any and are left out. Repeated nodes count once, with their least parent
    and mean score. Nodes whose ancestors form a ring have no root and no path.

    Sums of scores double their reach with a row a node; only the leaves that win are then led up through the same jumps.
    """
    nodes = nodes.filter("node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.avg(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("sum"))
    nodes = common.materialise(nodes, "nodes")
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    start = nodes.join(known, _up("parent"), "left").select("tree", "node", F.col("_n").alias("up"), "sum", F.lit(1).cast("long").alias("n"))
    start = reach = common.materialise(start, "reach")
    size = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, step = [], 1
    while step < size:
        more = reach.filter("up is not null")
        if more.isEmpty():
            break
        jumps.append(more.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_p")))
        far = reach.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_p"), F.col("sum").alias("_sum"), F.col("n").alias("_m"))
        more = more.join(far, _up("up")).select("tree", "node", F.col("_p").alias("up"), F.col("sum") + F.col("_sum"), F.col("n") + F.col("_m"))
        reach = common.materialise(reach.filter("up is null").union(more), "reach")
        step *= 2
    inner = start.filter("up is not null").select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    leaves = reach.filter("up is null").join(inner, _up("node"), "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("sum") / F.col("n")).alias("score"))
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("leaf"))))
    if branches is not None:
        leaves = leaves.filter(F.col("rank") <= branches)
    paths = common.materialise(leaves.select("tree", "leaf", "rank", "score", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("dist")), "paths")
    for k, jump in enumerate(jumps):
        more = paths.join(jump, _up("node")).select("tree", "leaf", "rank", "score", F.col("_p").alias("node"), F.col("dist") + (1 << k))
        paths = common.materialise(paths.union(more), "paths")
    return paths


def format_trees(messages: DataFrame, *, branches: int = 1, learned: str = LEARNED_ROLE) -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, spans) for the `branches` best paths of each tree of messages (tree, node, parent, score, role, text).

    Paths are those of tree_paths(). Null roles and texts count as empty. Rows that repeat a node stand together in its place, by
    role and text. Other columns don't matter.
    """
    messages = common.materialise(messages.select("tree", "node", "parent", "score", "role", "text"), "messages")
    paths = tree_paths(messages.select("tree", "node", "parent", "score"), branches)
    said = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), escape(F.col("role"), True).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == learned).alias("learned"))
    chosen = paths.join(said, _up("node"))
    head = F.concat(F.lit(HEAD), "role", F.lit(HEAD_END))
    turn = F.concat(head, "text", F.lit(END))
    order = Window.partitionBy("tree", "leaf").orderBy(F.col("dist").desc(), "role", "text")
    before = F.coalesce(F.sum(F.length(turn)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + len(BEGIN)
    rows = chosen.select("tree", "leaf", "rank", "score", F.row_number().over(order).alias("k"), turn.alias("turn"), F.when(F.col("learned"), F.struct((before + F.length(head)).alias("start"), F.length("text").cast("long").alias("length"))).alias("span"))
    turns = F.array_sort(F.collect_list(F.struct("k", "turn", "span")))
    out = rows.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), turns.alias("_turns"))
    return out.select(
        "tree",
        "leaf",
        "rank",
        "score",
        F.size("_turns").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join(F.col("_turns.turn"), "")).alias("formatted"),
        F.filter(F.col("_turns.span"), lambda s: s.isNotNull()).alias("spans"),
    )


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees of one branch: rows by turn, null turns first, ties by role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("long")
    rows = conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text")
    return rows.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


def _turns(formatted: Column) -> Column:
    """The array of turns of a formatted conversation, each without its end."""
    return F.filter(F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), END, -1), lambda t: t != "")


def _head(turn: Column) -> Column:
    return F.substring_index(turn, HEAD_END, 1)


def _read(turn: Column) -> tuple[Column, Column]:
    """Role and text of a turn, the text still escaped."""
    return unescape(F.substr(_head(turn), F.lit(len(HEAD) + 1))), F.substr(turn, F.length(_head(turn)) + len(HEAD_END) + 1)


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""

    def pair(turn: Column) -> Column:
        role, text = _read(turn)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(_turns(formatted), pair)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from format_trees(): turns, and the text under the loss mask.

    Turns and spans become rows, and a span is cut out of the turn that begins where it does, so that the work grows with the text
    and not with its square. All steps keep to the conversations' own partitions.
    """
    turn = F.transform(_turns(F.col("formatted")), lambda t, k: F.struct(k.alias("k"), t.alias("turn"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("length")))
    span = F.transform("spans", lambda s: F.struct(F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    rows = formatted.select("tree", "leaf", F.length("formatted").cast("long").alias("n"), F.explode(F.concat(turn, span)).alias("row")).select("tree", "leaf", "n", "row.*")
    order = Window.partitionBy("tree", "leaf").orderBy(F.col("k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("turn") + len(END)).over(order), F.lit(0)) + len(BEGIN)
    rows = rows.withColumn("start", F.coalesce("start", before + F.length(_head(F.col("turn"))) + len(HEAD_END)))
    rows = rows.withColumn("length", F.max("length").over(Window.partitionBy("tree", "leaf", "start"))).filter("k is not null")
    role, text = _read(F.col("turn"))
    learned = F.when(F.col("length").isNotNull(), unescape(F.substr(text, F.lit(1), F.col("length").cast("int"))))
    rows = rows.select("tree", "leaf", "n", "k", F.concat(role, F.lit("\n"), unescape(text), F.lit("\n")).alias("said"), learned.alias("learned"))
    out = rows.groupBy("tree", "leaf").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "said", "learned"))).alias("turns"))
    said, under = (F.array_join(F.col(f"turns.{c}"), "") for c in ("said", "learned"))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.col("n").alias("formatted_chars"),
    )
