"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees (node, parent). Iterative self-joins double the length of the upward jumps, then walk every leaf
back to its root in as many joins as the depth has binary digits: each round adds, for every row of a path so far, the
node one jump further up, so each (leaf, distance) pair is made exactly once. Branches are ranked by the mean score of
their messages; the best ``branches`` of each tree are formatted, each as one conversation.

Template: every turn is ``<s>[INST] role [/INST]text</s>``. Control strings inside role and text are escaped: backslashes
are doubled and a backslash is put behind the first character of each control string, which unescaping undoes exactly.
The loss mask is a list of spans (code points of the formatted text) that cover the assistant texts.

Edge cases: null text and role are empty; equal turns of one conversation are ordered by role and text; null turns come
first; a null conversation id is a conversation of its own; a node whose parent is missing is a root, and so is the least
node (by its name in JSON) of a cycle of parents; repeated rows of a conversation are turns each; a node of a tree that is
given more than once counts once, as its least row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

TURN, HEAD, BODY, END = "<s>", "[INST] ", " [/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees of one branch: node, parent, tree, role, text, score."""
    line = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = F.row_number().over(line)
    node = lambda n: F.struct(F.col("conv_id").alias("conv"), n.alias("place"))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", own)
    parent = F.when(F.col("n") > 1, node(F.col("n") - 1))
    return rows.select(node(F.col("n")).alias("node"), parent.alias("parent"), F.col("conv_id").alias("tree"), "role", "text", F.lit(0.0).alias("score"))


def jump_tables(first: DataFrame, nodes: int, scratch: Scratch, tag: str) -> tuple[list[DataFrame], bool]:
    """Jumps (key, above) of 1, 2, 4 .. steps upwards, and whether they ran past the number of nodes, as only a cycle lets them."""
    jumps = [scratch.save(first, f"{tag}-0")]
    while 1 << (len(jumps) - 1) <= nodes:
        last = jumps[-1]
        longer = last.select("key", F.col("above").alias("mid")).join(last.select(F.col("key").alias("mid"), "above"), "mid").select("key", "above")
        longer = scratch.save(longer, f"{tag}-{len(jumps)}")
        if longer.isEmpty():
            return jumps, False
        jumps.append(longer)
    return jumps, True


def cycle_heads(jumps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(key): the least node of every cycle. The longest jumps end on cycles and reach all of each; the least key ahead is
    doubled along the jumps."""
    ring = jumps[-1].select(F.col("above").alias("key")).distinct()
    least = scratch.save(ring.withColumn("least", F.col("key")), "least-0")
    for k, jump in enumerate(jumps):
        ahead = least.select(F.col("key").alias("above"), F.col("least").alias("other"))
        met = least.join(jump, "key").join(ahead, "above")
        least = scratch.save(met.select("key", F.least("least", "other").alias("least")), f"least-{k + 1}")
    return least.where("key = least").select("key")


def paths(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, up, at): every node ``at`` that lies ``up`` steps above a leaf, the leaf itself included.

    ``tree`` has key (a text that names the node, once each) and above (its parent's key, null at a root).
    """
    nodes = tree.count()
    known = tree.select("key").withColumnRenamed("key", "above")
    first = tree.select("key", "above").join(known.withColumn("real", F.lit(True)), "above", "left").where("real").select("key", "above")
    jumps, cyclic = jump_tables(first, nodes, scratch, "jump")
    if cyclic:
        heads = scratch.save(cycle_heads(jumps, scratch), "heads")
        first = first.join(heads, "key", "left_anti")
        jumps, _ = jump_tables(first, nodes, scratch, "cut")
    inner = first.select(F.col("above").alias("key")).distinct()
    walked = tree.join(inner, "key", "left_anti").select(F.col("key").alias("leaf"), F.lit(0).alias("up"), F.col("key").alias("at"))
    for k in reversed(range(len(jumps))):
        higher = walked.join(jumps[k].withColumnRenamed("key", "at"), "at").select("leaf", (F.col("up") + (1 << k)).alias("up"), F.col("above").alias("at"))
        walked = scratch.save(walked.unionByName(higher), f"walked-{k}")
    return walked


def format_trees(tree: DataFrame, branches: int = 1) -> DataFrame:
    """tree (node, parent, tree, role, text, score) -> tree, branch, formatted, loss_mask: one row per chosen path."""
    scratch = Scratch(tree.sparkSession, "chat")
    named = tree.withColumn("key", F.to_json(F.struct("node"))).withColumn("above", F.when(F.col("parent").isNotNull(), F.to_json(F.struct(F.col("parent").alias("node")))))
    one = F.min(F.struct("above", "tree", "role", "text", "score")).alias("row")  # a node that is given more than once
    named = scratch.save(named.groupBy("key").agg(one).select("key", "row.*"), "tree")
    walked = paths(named, scratch)
    laid = walked.join(named.select(F.col("key").alias("at"), "tree", "role", "text", "score"), "at")

    rank = W.partitionBy("tree").orderBy(F.col("worth").desc(), "leaf")
    chosen = laid.groupBy("leaf").agg(F.first("tree").alias("tree"), F.avg("score").alias("worth")).withColumn("branch", F.row_number().over(rank))
    chosen = chosen.where(F.col("branch") <= branches).select("leaf", "branch")

    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(TURN + HEAD), role, F.lit(BODY))
    turns = laid.join(chosen, "leaf").select("leaf", "branch", "tree", "up", F.col("role").alias("by"), head.alias("head"), text.alias("body"))
    before = W.partitionBy("leaf").orderBy(F.col("up").desc()).rowsBetween(W.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("by") == "assistant", F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("length")))
    piece = F.struct((-F.col("up")).alias("place"), F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    whole = turns.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("branch").alias("branch"), F.sort_array(F.collect_list(piece)).alias("turns"))
    return whole.select(
        "tree", "branch",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_mask"),
    )


def read_back(formatted: Column, loss_mask: Column) -> dict[str, Column]:
    """Turns (role and text, unescaped) and masked text of a formatted conversation."""
    pieces = F.split(formatted, TURN)
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, F.lit(BODY))
        role = F.substring(piece, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1)
        text = F.substring(piece, cut + len(BODY), F.length(piece) - cut - len(BODY) - len(END) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    masked = F.transform(loss_mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
    return {"turns": F.transform(pieces, turn), "loss_text": F.array_join(masked, "")}
