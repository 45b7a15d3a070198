"""Chat formatting of reply trees: self-joins over doubling distances walk from leaves to roots, branches are ranked by
score, and each chosen path becomes one conversation with marked turns and a loss mask.

Everything is DataFrame operations.  The walks move ids only; a text is read once to number it (where turns have no reply
links of their own), once to join it to its paths and once to gather a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import saved

#: Fixed by the template: a turn is START, role, line feed, text, END, line feed.
START, END = "<|im_start|>", "<|im_end|>"

MESSAGES = ("tree", "node", "parent", "role", "text", "score")


def escaped(text: Column) -> Column:
    """Text in which no mark can stand: every ``<``, backslashes, ``|`` gets one backslash more before the bar."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    r"""A role on one line: a backslash becomes ``\b``, a line feed ``\n``; marks as in texts."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit(r"\b")), F.lit("\n"), F.lit(r"\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit(r"\n"), F.lit("\n")), F.lit(r"\b"), F.lit("\\"))


def turn_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of plain conversations: each row answers the one before it by turn (nulls first, ties by role and text).

    Null ids make one conversation; null roles and texts are empty; repeated rows are turns of their own."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("bigint"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                       F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"))


def reply_messages(replies: DataFrame, tree: str, node: str, parent: str, role: str = "role", text: str = "text", score: str | None = None) -> DataFrame:
    """Messages of a table with reply links.  Rows that repeat a node of a tree are one message (the least by parent, role,
    text and score counts); a null node is a message that nothing can answer; null scores are 0, null roles and texts empty."""
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = replies.select(
        F.col(tree).alias("tree"), F.col(node).alias("node"),
        F.struct(F.col(parent).alias("parent"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), value.alias("score")).alias("m"))
    return rows.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*")


def ancestor_levels(messages: DataFrame) -> list[DataFrame]:
    """Level k: (tree, node, above, gained): the ancestor 2^k replies up and the scores from the node to below it.

    Level k + 1 is level k joined with itself, so a path of any depth takes its logarithm in rounds; each is a written
    table of ids.  A parent that is not in its tree counts as none.  Replies in a circle end when the distance exceeds the
    number of messages."""
    ids = messages.select("tree", "node", "parent", "score")
    present = ids.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"))
    level = saved(
        ids.where(F.col("parent").isNotNull())
        .join(present, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("parent") == F.col("node2")), "left_semi")
        .select("tree", "node", F.col("parent").alias("above"), F.col("score").alias("gained")))
    levels, most, reach = [], messages.count(), 1
    while not level.isEmpty():
        levels.append(level)
        if reach > most:
            break
        reach *= 2
        upper = level.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), F.col("above").alias("above2"), F.col("gained").alias("gained2"))
        level = saved(
            level.join(upper, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("above") == F.col("node2")))
            .select("tree", "node", F.col("above2").alias("above"), (F.col("gained") + F.col("gained2")).alias("gained")))
    return levels


def _climbed(rows: DataFrame, level: DataFrame) -> DataFrame:
    """``rows`` by their column node beside that node's ancestor of a level, where it has one."""
    upper = level.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), "above", "gained")
    return rows.join(upper, F.col("tree").eqNullSafe(F.col("tree2")) & F.col("node").eqNullSafe(F.col("node2")), "left").drop("tree2", "node2")


def best_paths(messages: DataFrame, levels: list[DataFrame], best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, node, place): the ``best`` root-to-leaf paths of every tree (None: all) by total score, ties by
    the smaller leaf; ``place`` counts from the root, 0.  Messages in a circle of replies, and those below one, have no
    root and are on no path."""
    ids = messages.select("tree", "node", "score")
    if not levels:
        ranked = ids.select("tree", F.col("node").alias("leaf"), F.col("score").alias("total"), F.lit(0).cast("bigint").alias("depth"))
    else:
        answered = levels[0].select(F.col("tree").alias("tree2"), F.col("above").alias("node2"))
        walk = ids.join(answered, F.col("tree").eqNullSafe(F.col("tree2")) & (F.col("node") == F.col("node2")), "left_anti")
        walk = walk.select("tree", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("depth"))
        for k in reversed(range(len(levels))):
            up = F.col("above").isNotNull()
            walk = _climbed(walk, levels[k]).select(
                "tree", "leaf", F.coalesce("above", "node").alias("node"), (F.col("total") + F.coalesce("gained", F.lit(0.0))).alias("total"),
                (F.col("depth") + F.when(up, 2**k).otherwise(0)).alias("depth"))
        # What still has an ancestor after every distance has been climbed once hangs on a circle.
        walk = _climbed(walk, levels[0]).where(F.col("above").isNull()).select("tree", "leaf", "node", "total", "depth")
        roots = ids.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), "score")
        ranked = walk.join(roots, F.col("tree").eqNullSafe(F.col("tree2")) & F.col("node").eqNullSafe(F.col("node2"))).select(
            "tree", "leaf", (F.col("total") + F.col("score")).alias("total"), "depth")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    rows = ranked.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.col("depth").alias("place"))
    for k in reversed(range(len(levels))):
        # Sums of different powers of two reach every distance, each one once.
        own = F.struct("node", "place")
        upper = F.struct(F.col("above").alias("node"), (F.col("place") - 2**k).alias("place"))
        rows = _climbed(rows, levels[k]).select(
            "tree", "leaf", "rank", F.explode(F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, upper))).alias("at"))
        rows = rows.select("tree", "leaf", "rank", "at.node", "at.place")
    return rows


def format_paths(messages: DataFrame, paths: DataFrame, learned: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss): each path as one text, and for every turn the (start, length) in code
    points of what is learned, null for turns of other roles than ``learned``.

    Turns are written and measured row by row; their offsets are a running sum along the path.  A formatted conversation
    is one row, as a document is."""
    texts = messages.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), "role", "text")
    rows = paths.join(texts, F.col("tree").eqNullSafe(F.col("tree2")) & F.col("node").eqNullSafe(F.col("node2")))
    rows = rows.select(
        "tree", "leaf", "rank", "place", (F.col("role") == learned).alias("learn"),
        F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    span = F.when(F.col("learn"), F.struct(start.cast("bigint").alias("start"), F.char_length("body").cast("bigint").alias("length")))
    turns = rows.select("tree", "leaf", "rank", F.struct("place", "piece", span.alias("span")).alias("turn"))
    gathered = turns.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return gathered.select(
        "tree", "leaf", "rank", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"), F.col("turns.span").alias("loss"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, rank, place, role, text, learned) read from formatted texts and loss masks; ``learned`` is the text under
    the mask, null where there is none."""
    parts = F.split("formatted", START.replace("|", r"\|"))
    rows = formatted.select("tree", "leaf", "rank", F.posexplode(F.arrays_zip(F.slice(parts, 2, F.size(parts)).alias("part"), F.col("loss").alias("span"))).alias("place", "t"))
    rows = rows.select("tree", "leaf", "rank", "place", "t.part", "t.span")
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("part") + len(START)).over(before), F.lit(0)) + len(START)
    rows = rows.withColumns({"start": start, "head": F.substring_index("part", "\n", 1)})
    body = F.expr(f"substring(part, char_length(head) + 2, char_length(part) - char_length(head) - {len(END) + 2})")
    learned = F.expr("substring(part, cast(span.start - start as int) + 1, cast(span.length as int))")
    return rows.select("tree", "leaf", "rank", F.col("place").cast("bigint").alias("place"), unescaped_role(F.col("head")).alias("role"),
                       unescaped(body).alias("text"), unescaped(learned).alias("learned"))


def format_replies(messages: DataFrame, best: int | None = 1, learned: str = "assistant") -> DataFrame:
    """The ``best`` root-to-leaf paths of every reply tree, each as one formatted conversation (see ``format_paths``).

    ``messages`` come from ``turn_messages`` or ``reply_messages``; other columns of the source are not read.  They are
    written once, so that ids and texts come from the same rows.  An empty table gives no conversation; empty texts are
    turns with nothing in them.  A hot tree is spread by its nodes in every walk; only its own conversation is gathered."""
    held = saved(messages.select(*MESSAGES))
    return format_paths(held, best_paths(held, ancestor_levels(held), best), learned)
