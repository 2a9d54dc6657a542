"""Chat formatting of reply trees.

Messages point to the message they answer.  Iterative self-joins double the distance that every message
knows upwards: after ``k`` rounds it knows its ancestor ``2^k`` replies above and the score collected on the
way, so depths take the logarithm of their length in rounds.  Leaves then carry the score of their whole
branch; branches are ranked by it within their tree and the chosen ones are enumerated by the same stored
jumps: a set of (leaf, message) pairs that reaches ``2^k`` replies up doubles with each join.  Rounds hold
ids and scores only and are written to the shared folder; texts are joined once, to the chosen paths.

A path becomes one conversation: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts ``\\`` is doubled and ``<|`` becomes ``<\\|`` (in roles also a line break ``\\n``), so a control string
cannot arise from content and ``unescape`` restores it.  Everything is DataFrame functions.

Defined results: null roles and texts are empty; a null score is zero; a message whose parent is unknown, is
null or is itself starts a tree's path; messages on a cycle of replies reach no start and are on no path; of
rows with the same tree and message id the smallest (by parent, role, text, score) counts; a null tree id is
a tree of its own; equal scores are ranked by leaf id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insight.llm.storage import stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(s: Column) -> Column:
    """Reversibly make every ``<|`` impossible."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(s: Column) -> Column:
    return F.regexp_replace(s, r"\\([\\|])", "$1")


def escape_role(s: Column) -> Column:
    return F.replace(escape(s), F.lit("\n"), F.lit("\\n"))


def unescape_role(s: Column) -> Column:
    line_breaks = F.regexp_replace(s, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(line_breaks)


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored tables of ``2^k``-th ancestors, and every message's depth and score from its start."""
    parents = nodes.select("tree", F.col("node").alias("up"))
    known = nodes.where("parent is not null and parent <> node").select(
        "tree", "node", F.col("parent").alias("up"), "score").join(parents, ["tree", "up"])
    known = stored(known.select("tree", "node", "up", "score", F.lit(1).cast("long").alias("far")), "chat-jump")
    starts = nodes.join(known, ["tree", "node"], "left_anti").select(
        "tree", "node", F.col("score").alias("total"), F.lit(0).cast("long").alias("depth"))
    levels, settled, n = [], stored(starts, "chat-settled"), nodes.count()
    reach = 1
    while reach <= 2 * n and not known.isEmpty():
        levels.append(known)
        done = settled.select("tree", F.col("node").alias("up"), F.col("total").alias("t"), F.col("depth").alias("d"))
        arrived = known.join(done, ["tree", "up"]).select("tree", "node", (F.col("score") + F.col("t")).alias("total"),
                                                          (F.col("far") + F.col("d")).alias("depth"))
        settled = stored(settled.unionByName(arrived), "chat-settled")
        above = known.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("far").alias("f2"))
        known = stored(known.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"),
            (F.col("far") + F.col("f2")).alias("far")), "chat-jump")
        reach *= 2
    return levels, settled


def branches(messages: DataFrame, top: int | None = None) -> DataFrame:
    """Chosen root-to-leaf paths: ``tree``, ``leaf``, ``rank`` (1: best score), ``total``, ``node``, ``place``.

    ``messages``: ``tree``, ``node``, ``parent``, ``score``; ``top``: best paths per tree, None for all.
    """
    nodes = stored(messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("m"))
                   .select("tree", "node", "m.parent", F.coalesce("m.score", F.lit(0.0)).cast("double").alias("score")), "chat-nodes")
    levels, settled = _jumps(nodes)
    answered = nodes.where("parent <> node").select("tree", F.col("parent").alias("node")).distinct()
    leaves = settled.join(answered, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    leaves = leaves.where(F.col("rank") <= top) if top else leaves
    paths = leaves.select("tree", F.col("node").alias("leaf"), "rank", "total", "depth", "node", F.lit(0).cast("long").alias("back"))
    for known in levels:
        jump = known.select("tree", "node", "up", "far")
        higher = paths.join(jump, ["tree", "node"]).select(
            "tree", "leaf", "rank", "total", "depth", F.col("up").alias("node"), (F.col("back") + F.col("far")).alias("back"))
        paths = stored(paths.unionByName(higher), "chat-paths")
    return paths.withColumn("place", F.col("depth") - F.col("back")).drop("depth", "back")


def format_paths(messages: DataFrame, top: int | None = None, trained: str = "assistant") -> DataFrame:
    """One row per chosen path: ``tree``, ``leaf``, ``rank``, ``formatted`` and ``turns``.

    ``messages``: ``tree`` and ``node`` (not null), ``parent``, ``role``, ``text``, ``score``.  ``turns`` has, in
    order, the offset of each turn in ``formatted`` and the span under the loss mask: the text of turns of
    role ``trained``, an empty span otherwise (code points).
    """
    said = messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    said = said.select("tree", "node", "m.parent", "m.score", F.coalesce("m.role", F.lit("")).alias("role"),
                       F.coalesce("m.text", F.lit("")).alias("text"))
    said = stored(said, "chat-messages")
    chosen = branches(said.select("tree", "node", "parent", "score"), top)
    body, head = escape(F.col("text")), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = chosen.join(said.select("tree", "node", head.alias("head"), body.alias("body"), (F.col("role") == trained).alias("mask")),
                        ["tree", "node"])
    length = F.length("head") + F.length("body") + F.lit(len(END))
    path = Window.partitionBy("tree", "leaf").orderBy("place")
    turns = turns.withColumn("start", (F.sum(length.cast("long")).over(path) - length).cast("long"))
    turns = turns.select("tree", "leaf", "rank", "place", F.concat("head", "body", F.lit(END)).alias("piece"), F.struct(
        "start", (F.col("start") + F.length("head")).alias("loss_start"),
        F.when(F.col("mask"), F.length("body")).otherwise(0).cast("long").alias("loss_chars")).alias("turn"))
    whole = turns.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("place", "piece", "turn"))).alias("t"))
    return whole.select("tree", "leaf", "rank", F.array_join("t.piece", "").alias("formatted"), F.col("t.turn").alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``said`` (role and text of every turn) and ``learnt`` (all text under the loss mask), unescaped."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    out = formatted.withColumn("_pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    said = F.transform("_pieces", lambda p: F.struct(
        unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))
    learnt = F.transform(F.arrays_zip(F.col("_pieces").alias("p"), F.col("turns").alias("t")), lambda z: unescape(F.substr(
        z["p"], (z["t"]["loss_start"] - z["t"]["start"] + 1).cast("int"), z["t"]["loss_chars"].cast("int"))))
    return out.withColumn("said", said).withColumn("learnt", F.array_join(learnt, "")).drop("_pieces")


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: every row answers the one before it (by turn, role, text; nulls first)."""
    told = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "turn", "role", "text")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return told.select("tree", F.row_number().over(order).cast("long").alias("node"), "role", "text").select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Digests of every formatted conversation, read back from the output."""
    out = read_back(format_paths(conversation_trees(conversations), top=1))
    told = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.expr("try_cast(tree as bigint)").alias("conv_id"), F.size("said").cast("long").alias("n_turns"),
                      F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
                      F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))
