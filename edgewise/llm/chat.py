"""Chat formatting of reply trees, by DataFrame operations only.

Messages are (tree, node, parent, role, text, score). Iterative self-joins double the known way to the root: after round k
a node knows its ancestor 2^k steps up, the score and the length of the way between. Leaves are ranked within their
tree by the summed score of their path; for each chosen leaf the same doubled steps, kept from each round, enumerate the
nodes of its path, each exactly once. A path is then formatted as one conversation.

Template: each turn is ``<s>role\\ntext</s>``. In roles and texts ``&``, ``<``, ``[`` (and in roles line feeds) are written
as ``&amp;``, ``&lt;``, ``&lb;``, ``&nl;``, so no control string of this or of bracket templates can occur inside and
every text can be read back. The loss mask is a list of (start, length) in code points over the assistant's texts.

Texts wait in a written table until the paths are known. Only shared folders are used for it.

Defined cases: null roles and texts count as empty; very long texts are handled whole; a parent that is missing makes a root; nodes on a cycle have no path
and are left out; leaves of equal score are ranked by node; repeated rows must differ in ``node`` (``conversation_tree``
numbers them); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.session import cut, prepare

from .common import stored

ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("\n", "&nl;"), ("[", "&lb;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by turn (then role, then text).

    Rows without conv_id are conversations of their own kind: one tree whose id is null.
    """
    prepare(conversations.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(F.col("conv_id").alias("tree"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def chosen_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, rank, node, position (0 at the root) for the ``best`` root-to-leaf paths of each tree."""
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.lit(True).alias("there"))
    # A null-safe tree key: conversations without an id are one tree.
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))
    jump = cut(nodes.join(known, same, "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("steps")))
    total = jump.count()
    # Nodes that have reached their root are done; only the others are joined again.
    done, open_ = cut(jump.where("up IS NULL")), cut(jump.where("up IS NOT NULL"))
    rounds, left, before = [], open_.count(), -1
    while left and not (left == before and 1 << len(rounds) > total):
        rounds.append(open_.select("tree", "node", "up"))
        above = done.union(open_).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("steps").alias("d2"))
        met = F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))
        jump = cut(open_.join(above, met).select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("steps") + F.col("d2")).alias("steps")))
        done, open_ = done.union(cut(jump.where("up IS NULL"))), cut(jump.where("up IS NOT NULL"))
        left, before = open_.count(), left
    parents = nodes.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = done.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    path = cut(leaves.withColumn("rank", rank).where(F.col("rank") <= best).select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("steps") - 1).alias("position")))
    for k, step in enumerate(rounds):
        step = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        above = path.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        # Only checkpointed parts are united, so plans stay small.
        path = path.union(cut(above.select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position"))))
    return path


def format_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, rank, formatted, loss (array of start and length in code points) for each chosen path."""
    messages = stored(messages.select("tree", "node", "parent", "role", "text", "score"))
    paths = chosen_paths(messages, best)
    texts = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths.join(texts, paths["tree"].eqNullSafe(F.col("t")) & (paths["node"] == texts["n"]))
    head = F.concat(F.lit("<s>"), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
    rows = rows.select("tree", "leaf", "rank", "position", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + F.lit(4)
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head"))
    turn = F.struct("position", F.concat("head", "body", F.lit("</s>")).alias("turn"), F.when(F.col("role") == ASSISTANT, F.struct(F.col("start").alias("start"), F.char_length("body").cast("long").alias("length"))).alias("span"))
    packed = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda x: x["span"]), lambda s: s.isNotNull())
    return packed.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    turns = F.split(formatted, "</s>")
    turns = F.slice(turns, 1, F.size(turns) - 1)
    parts = F.transform(turns, lambda t: F.split(F.substring(t, 4, 2**30), "\n", 2))
    return F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
