"""Chat formatting of reply trees, in DataFrame functions alone.

Branches are scored first: ``up`` tables hold each node's ancestor 2**k steps
above and the scores on the way, made by self-joins that double their reach, and
every leaf climbs to its root from the longest step to the shortest, one row a
leaf.  Branches are ranked by the sum of their nodes' scores.  Only the chosen
leaves' paths are then listed, by the same tables, so a path of n nodes takes
about log2(n) joins, and each chosen path becomes one conversation.

A turn is written ``<s>[INST]role[/INST]text</s>``.  A control string inside a
role or text gets a backslash after its first character, one that has backslashes
there gets one more; taking one off restores the text exactly.  The loss mask is
a list of spans, in code points of the formatted text, of the assistant's texts.

Text is shuffled once: by tree, together with the paths of the tree.

Defined cases: null roles, texts and scores count as empty and 0; a null tree id
is a tree of its own; a node whose parent is missing is a root; of several rows
with one node id of a tree the least by parent, role, text and score counts
(``from_turns`` numbers repeated rows, so that each is a turn); a node without an
id is left out, as nothing can refer to it; nodes on a cycle, and what hangs on
one, have no root and are left out; empty tables give no rows; long texts stay
whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash

_AFTER_FIRST = r"(/?s>|/?INST\])"


def escape(c):
    return F.regexp_replace(c, r"([<\[])(\\*)" + _AFTER_FIRST, r"$1$2\\$3")


def unescape(c):
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _AFTER_FIRST, "$1$2$3")


def _key(c):
    return F.coalesce(c.cast("string"), F.lit("\u0000"))


def from_turns(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as trees of one branch: tree_id, _tree, node_id, parent_id, score, role, text; repeated turns follow each other by role and text."""
    held = rows.select(F.col(tree).alias("tree_id"), _key(F.col(tree)).alias("_tree"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("_tree").orderBy("_turn", "role", "text")).cast("long")
    return held.select("tree_id", "_tree", node.alias("node_id"), "role", "text").select("tree_id", "_tree", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")


def chains(rows: DataFrame, tree: str = "conv_id") -> DataFrame:
    """_tree, node, parent and score of what from_turns makes of the rows, from the number of rows alone."""
    sizes = rows.groupBy(_key(F.col(tree)).alias("_tree")).agg(F.count("*").alias("n"))
    nodes = sizes.select("_tree", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("node"))
    return nodes.select("_tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))


def _steps(shape: DataFrame) -> list[DataFrame]:
    """_tree, node, above and sum (of the scores from the node up to below `above`), for 1, 2, 4, ... steps, as far as there are any."""
    known = shape.select("_tree", F.col("node").alias("parent"))
    step = stash(shape.filter("parent IS NOT NULL").join(known, ["_tree", "parent"], "left_semi").select("_tree", "node", F.col("parent").alias("above"), F.col("score").alias("sum")), "up")
    largest = shape.groupBy("_tree").count().agg(F.max("count").alias("n")).first()["n"] or 0
    steps, reach = [step], 1
    while reach < largest and not steps[-1].isEmpty():  # beyond the largest tree only cycles go on
        last = steps[-1]
        top = last.select("_tree", F.col("node").alias("above"), F.col("above").alias("_top"), F.col("sum").alias("_more"))
        steps.append(stash(last.join(top, ["_tree", "above"]).select("_tree", "node", F.col("_top").alias("above"), (F.col("sum") + F.col("_more")).alias("sum")), "up"))
        reach *= 2
    return steps


def paths(shape: DataFrame, branches: int | None) -> DataFrame:
    """_tree, leaf, node, up, rank and branch_score: the nodes of the best branches, `up` steps above their leaf. shape: _tree, node, parent, score; each node once."""
    shape = stash(shape, "shape")
    steps = _steps(shape)
    leaves = shape.join(steps[0].select("_tree", F.col("above").alias("node")).distinct(), ["_tree", "node"], "left_anti")
    climb = leaves.select("_tree", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("sum"))
    for step in reversed(steps):
        on = step.select("_tree", "node", "above", F.col("sum").alias("_more"))
        climb = climb.join(on, ["_tree", "node"], "left").select("_tree", "leaf", F.coalesce("above", "node").alias("node"), (F.col("sum") + F.coalesce("_more", F.lit(0.0))).alias("sum"))
    below = steps[0].select("_tree", "node")
    tops = shape.join(below, ["_tree", "node"], "left_anti").select("_tree", "node", "score")  # roots: what still stands elsewhere is on a cycle
    scored = climb.join(tops, ["_tree", "node"]).select("_tree", "leaf", (F.col("sum") + F.col("score")).alias("branch_score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("_tree").orderBy(F.desc("branch_score"), "leaf")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    found = stash(ranked.select("_tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"), "rank", "branch_score"), "paths")
    for k in reversed(range(len(steps))):
        more = found.join(steps[k], ["_tree", "node"]).select("_tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"), "rank", "branch_score")
        now = stash(found.unionByName(more), "paths")
        discard(found, steps[k])
        found = now
    discard(shape)
    return found


def format_trees(nodes: DataFrame, branches: int | None = 1, shape: DataFrame | None = None) -> DataFrame:
    """The best branches of each tree, one conversation each: tree_id, leaf_id, rank, score, formatted, spans (of the loss mask: first and last code point, the last not included).

    nodes: tree_id, node_id, parent_id, score, role, text.  branches None: all.
    shape: _tree, node, parent and score of the same nodes, where each node id is
    known to occur once and these are cheaper to have otherwise.
    """
    own = nodes.select(
        "tree_id",
        (F.col("_tree") if "_tree" in nodes.columns else _key(F.col("tree_id"))).alias("_tree"),
        F.col("node_id").alias("node"),
        F.col("parent_id").alias("parent"),
        F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    if shape is None:
        own = own.filter("node IS NOT NULL").groupBy("_tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("_least"), F.first("tree_id").alias("tree_id"))
        own = own.select("tree_id", "_tree", "node", "_least.*")
        shape = own.select("_tree", "node", "parent", "score")
    # rows that are partitioned by tree are joined and collected as they lie
    nodes.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    turns = own.select("tree_id", "_tree", "node", "role", "text").join(paths(shape, branches), ["_tree", "node"])
    head, body = F.concat(F.lit("<s>[INST]"), escape(F.col("role")), F.lit("[/INST]")), escape(F.col("text"))
    turns = turns.select("tree_id", "_tree", "leaf", "rank", "branch_score", "up", "role", head.alias("head"), body.alias("body"))
    so_far = Window.partitionBy("_tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("head") + F.length("body") + 4).over(so_far)
    turns = turns.withColumn("end", end).select(
        "tree_id", "_tree", "leaf", "rank", "branch_score", (-F.col("up")).alias("at"), F.concat("head", "body", F.lit("</s>")).alias("piece"),
        F.when(F.col("role") == "assistant", F.struct((F.col("end") - 4 - F.length("body")).alias("first"), (F.col("end") - 4).alias("last"))).alias("span"),
    )
    whole = turns.groupBy("_tree", "leaf").agg(F.first("tree_id").alias("tree_id"), F.first("rank").alias("rank"), F.first("branch_score").alias("score"), F.sort_array(F.collect_list(F.struct("at", "piece", "span"))).alias("x"))
    return whole.select("tree_id", F.col("leaf").alias("leaf_id"), "rank", "score", F.array_join("x.piece", "").alias("formatted"), F.filter("x.span", lambda s: s.isNotNull()).alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The formatted conversations with turns (role and text, unescaped) and loss (the text under the mask, unescaped), from the formatted text alone."""
    loss = F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int"))))
    pieces = F.expr("slice(split(formatted, '</s>'), 1, size(split(formatted, '</s>')) - 1)")
    cut = F.expr("transform(_pieces, p -> struct(substr(p, 10, locate('[/INST]', p) - 10) AS role, substr(p, locate('[/INST]', p) + 7) AS text))")
    turns = F.transform(cut, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    return formatted.withColumn("_pieces", pieces).withColumn("turns", turns).withColumn("loss", F.array_join(loss, "")).drop("_pieces")
