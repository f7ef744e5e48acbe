"""Reply trees to training conversations, in DataFrame functions only.

Messages point to their parents. Iterated self-joins double each message's pointer up the tree,
adding up depth and score on the way, so a thread of n messages takes log2(n) joins. Leaves
are ranked per conversation by the score of their branch; the ancestors of the chosen leaves
are gathered through the same pointers, and each root-to-leaf path becomes one conversation.

The template marks every turn, ``<|turn|>role\\ntext<|end|>``. Control strings inside
roles and texts are broken by a backslash escape that can be undone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.tables import written

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this and other common templates, and what stands for their first character.
CONTROLS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
STANDS_FOR = {"<": "\\l", "[": "\\b", "\n": "\\n"}


def escaped(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """Backslashes double and each control string's first character becomes its escape."""
    pairs = [("\\", "\\\\")] + [(c, STANDS_FOR[c[0]] + c[1:]) for c in controls]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescaped(text: Column) -> Column:
    """The text that :func:`escaped` was given: pairs of backslashes are read first, from the left."""
    back = lambda t: reduce(lambda x, p: F.replace(x, F.lit(p[1]), F.lit(p[0])), STANDS_FOR.items(), t)
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), back), "\\")


def chosen_paths(messages: DataFrame, branches: int = 1, whole: bool = False) -> DataFrame:
    """(key, leaf, id, depth) for every message on the ``branches`` best root-to-leaf paths per key.

    ``messages``: key, id, parent (null for a root; a parent that does not exist makes a root),
    score. Branches are ranked by the sum of their scores, then the smaller leaf id. Messages
    whose parents form a circle hang on no root and are left out. (key, id) must be unique. ``whole`` promises that
    ``messages`` are a written table in which every parent exists.
    """
    m = messages.select("key", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    if whole:
        levels = [m.select("key", "id", F.col("parent").alias("up"), F.lit(1).alias("depth"), "score")]
    else:
        ids = m.select("key", F.col("id").alias("parent"), F.lit(True).alias("there"))
        up = m.join(ids, ["key", "parent"], "left").select("key", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).alias("depth"), "score")
        levels = [written(up, "reply-pointers")]
    parents = levels[0].select("key", F.col("up").alias("id")).filter("id is not null")
    open_ = levels[0].filter("up is not null").count()
    while open_:
        low = levels[-1]
        over = low.select("key", F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("score").alias("gain"))
        pending = low.filter("up is not null").join(over, ["key", "up"]).select("key", "id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("gain")).alias("score"))
        levels.append(written(low.filter("up is null").unionByName(pending), "reply-pointers"))
        left = levels[-1].filter("up is not null").count()
        if left == open_:
            break  # what is left runs in circles
        open_ = left
    settled = levels[-1].filter("up is null")
    leaves = settled.join(parents, ["key", "id"], "left_anti")
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    path = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches).select("key", F.col("id").alias("leaf"), "id")
    for n, level in enumerate(levels[:-1], 1):
        above = path.join(level.filter("up is not null").select("key", "id", "up"), ["key", "id"]).select("key", "leaf", F.col("up").alias("id"))
        path = path.unionByName(above)
        if n < len(levels) - 1:
            path = written(path, "reply-paths")  # read twice by the next level; the last one is read once
    return path.join(settled.select("key", "id", "depth"), ["key", "id"]).select("key", "leaf", "id", "depth")


def formatted(messages: DataFrame, branches: int = 1, whole: bool = False) -> DataFrame:
    """One row per chosen path: key, leaf, n_turns, text and loss_spans.

    ``messages``: key, id, parent, score, role, text. ``loss_spans`` are [start, end) code points
    of the assistant's texts in ``text``. Null roles and texts are empty. ``whole``: see :func:`chosen_paths`.
    """
    path = chosen_paths(messages, branches, whole)
    own = messages.select("key", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    t = path.join(own, ["key", "id"]).select(
        "key", "leaf", "depth", "role", F.concat(F.lit(TURN), escaped(F.col("role"), (*CONTROLS, "\n")), F.lit("\n")).alias("head"), escaped(F.col("body")).alias("body")
    )
    size = F.length("head") + F.length("body") + len(END)
    so_far = F.sum(size).over(Window.partitionBy("key", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("end", so_far - len(END)).withColumn("start", F.col("end") - F.length("body"))
    turns = F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit(END)).alias("turn"))))
    spans = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("start", "end"))))
    grouped = t.groupBy("key", "leaf").agg(turns.alias("turns"), spans.alias("loss_spans"))
    return grouped.select("key", "leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("text"), "loss_spans")


def turns_of(text: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    part = F.filter(F.split(text, r"<\|turn\|>", -1), lambda p, i: i > 0)

    def one(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        start = F.length(role) + 2
        body = F.substring(p, start, F.length(p) - len(END) + 1 - start)
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(part, one)


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def from_turns(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each replies to the one before.

    Turns of one number are ordered by role and text, and repeated rows stay. A null conv_id is
    a conversation of its own. Texts are ordered once: the result is written, and the joins that
    follow the pointers read its keys alone.
    """
    c = conversations.select(F.struct("conv_id").alias("key"), "turn", "role", "text")
    n = F.row_number().over(Window.partitionBy("key").orderBy("turn", "role", "text"))
    c = c.withColumn("id", n.cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return written(c.select("key", "id", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text"), "messages")
