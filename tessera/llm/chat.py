"""Chat formatting of reply trees.

Messages form trees: each names the message that it answers. Every path from a root to a leaf is one
conversation. Paths are enumerated by iterative self-joins over jumps: each message's parent, then the parent's
parent, then the ancestor four messages up, and so on, so that a tree of depth d takes about log2(d) rounds and as
many rows a message. Leaves climb by the longest jumps first, which gives depths and the sums of scores that rank
the paths of a tree; the messages of the chosen paths are reached by every sum of jumps once.

Template. A conversation is the concatenation of its turns, each

    <s>[INST] role [/INST] text</s>

with role and text escaped. Escapes: ``\\`` is written ``\\\\``; in a control string (``<s>``, ``</s>``, ``[INST]``,
``[/INST]``, in any letter case) the first character ``<`` is written ``\\l`` and ``[`` is written ``\\b``. So no control
string of a text survives, and a single left-to-right pass restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, int64

#: The control strings of the template.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST] ", " [/INST] "
CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])", re.IGNORECASE)
ESCAPED = re.compile(r"\\[\\lb]")
WRITTEN = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
#: Stands for a null conversation id in joins; it is no id of its own.
NO_ID = -(1 << 63)
READ = {v: k for k, v in WRITTEN.items()}


@dataclass(frozen=True)
class ChatConfig:
    """assistant: role whose texts are under the loss mask. best: paths kept of each tree, None for all."""

    assistant: str = "assistant"
    best: int | None = None


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: WRITTEN[m[0]], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: READ[m[0]], text)


def format_turns(turns: list[tuple[str, str]], assistant: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and (start, end) code points of each assistant text in it."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        before = f"{BEGIN}{OPEN}{escape(role)}{CLOSE}"
        body = escape(text)
        start = at + len(before)
        if role == assistant:
            mask.append((start, start + len(body)))
        parts += [before, body, END]
        at = start + len(body) + len(END)
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The inverse of format_turns."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn.removeprefix(BEGIN + OPEN).split(CLOSE, 1)
        out.append((unescape(role), unescape(text)))
    return out


def reply_paths(messages: DataFrame, stage: Stage, best: int | None = None) -> DataFrame:
    """tree, path (0 is the best ranked), place (0 is the root), msg for every root-to-leaf path.

    messages has tree, msg (unique within its tree), parent and score; the parent must have a smaller msg,
    otherwise, or if it is missing, the message is a root; a null score counts 0. Sums of scores count to nine
    places; ties between paths go to the smaller leaf. An empty table has no paths.
    """
    known = messages.select("tree", "msg", F.when(F.col("parent") < F.col("msg"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    there = known.select("tree", F.col("msg").alias("parent"), F.lit(True).alias("there"))
    linked = known.join(there, ["tree", "parent"], "left").select("tree", "msg", F.when(F.col("there"), F.col("parent")).alias("parent"), "score")
    linked = stage.write(linked, "linked")
    # jump: from a message to one 2**level messages up; total: the scores on the way, the upper end's left out
    jump = stage.write(linked.where("parent is not null").select("tree", "msg", F.col("parent").alias("up"), F.col("score").alias("total")), "jumps-0")
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        upper = jump.select("tree", F.col("msg").alias("up"), F.col("up").alias("then"), F.col("total").alias("plus"))
        longer = jump.join(upper, ["tree", "up"]).select("tree", "msg", F.col("then").alias("up"), (F.col("total") + F.col("plus")).alias("total"))
        jump = stage.write(longer, f"jumps-{len(jumps)}")
    parents = linked.where("parent is not null").select("tree", F.col("parent").alias("msg")).distinct()
    climbing = linked.join(parents, ["tree", "msg"], "left_anti").select("tree", F.col("msg").alias("leaf"), "msg", F.lit(0.0).alias("total"), F.lit(0).alias("depth"))
    for k in reversed(range(len(jumps))):
        step = jumps[k].select("tree", "msg", "up", F.col("total").alias("plus"))
        climbing = climbing.join(step, ["tree", "msg"], "left").select(
            "tree", "leaf", F.coalesce("up", "msg").alias("msg"), (F.col("total") + F.coalesce("plus", F.lit(0.0))).alias("total"), (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth")
        )
    whole = climbing.join(linked.select("tree", "msg", "score"), ["tree", "msg"]).withColumn("total", F.col("total") + F.col("score"))
    ranked = whole.withColumn("path", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.round("total", 9)), "leaf")) - 1)
    if best is not None:
        ranked = ranked.where(F.col("path") < best)
    rows = stage.write(ranked.select("tree", "path", F.col("depth").alias("place"), F.col("leaf").alias("msg")), "paths")
    for k in reversed(range(len(jumps))):
        more = rows.join(jumps[k].select("tree", "msg", "up"), ["tree", "msg"]).select("tree", "path", (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("msg"))
        rows = stage.write(rows.unionByName(more), f"paths-{k}")
    return rows


def _format(rows: DataFrame, config: ChatConfig) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns], config.assistant) for turns in batch.column("turns").to_pylist()]
            mask = pa.array([[list(m) for m in masks] for _, masks in done], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("path"), pa.array([t for t, _ in done], pa.string()), mask], ["conv_id", "path", "formatted", "mask"])

    return rows.mapInArrow(run, "conv_id long, path int, formatted string, mask array<array<bigint>>")


def format_messages(messages: DataFrame, stage: Stage, config: ChatConfig = ChatConfig()) -> DataFrame:
    """Writes conv_id, path, formatted, mask for every path and returns the table as read back.

    messages has tree, msg, parent, score, role and text; a null role or text reads as empty.
    """
    places = reply_paths(messages, stage, config.best)
    texts = messages.select("tree", "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = places.join(texts, ["tree", "msg"]).groupBy("tree", "path").agg(turns.alias("turns"))
    return stage.write(_format(grouped.select(F.nullif("tree", F.lit(NO_ID)).alias("conv_id"), "path", "turns"), config), "formatted")


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees without branches: each row answers the one before it.

    Rows go by turn, then role, then text, nulls first; repeated rows are turns of their own. Rows with a
    null conv_id make up one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce("conv_id", F.lit(NO_ID)).alias("tree"), F.row_number().over(order).cast("long").alias("msg"), "role", "text")
    return rows.select("tree", "msg", (F.col("msg") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()):
                turns = parse_turns(text)
                loss = "".join(unescape(text[a:b]) for a, b in mask)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            n, turns, chars, loss, size = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), int64(n), pa.array(turns, pa.string()), int64(chars), pa.array(loss, pa.string()), int64(size)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations_digest(conversations: DataFrame, stage: Stage) -> DataFrame:
    """All conversations and conversation -1, which holds the template's own control strings, as ``digest`` gives them.

    Null roles and texts read as empty, texts of any length are formatted whole, rows that repeat are turns of their
    own, and rows with one turn go by role and text. Rows without conv_id make up one conversation, without an id. An
    empty table gives conversation -1 only. Columns other than conv_id, turn, role and text are left out.
    """
    spark = conversations.sparkSession
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return digest(format_messages(linear(conversations.select("conv_id", "turn", "role", "text").unionByName(own)), stage))
