"""Reply trees to chat text.

Iterative self-joins enumerate the root-to-leaf paths: first each message's
ancestors 1, 2, 4, ... steps up (each table is the last one joined with itself),
then the leaves' paths from the longest steps down, so a tree of depth d takes
about 2 log2(d) joins and no row but the paths' own is made.  Branches are ranked
by score and each chosen path is formatted as one conversation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.llm.storage import materialize

# Strings that chat templates give a meaning to.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
START, END, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"

_OPENING = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL) + r"|\\")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    """A text without control strings: a backslash breaks each after its first
    character; backslashes double."""
    return _OPENING.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans (code points) of the texts that the
    loss is taken on: the assistant's, without the marks around them."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape(role.replace('%', '%25').replace(chr(10), '%0A'))}\n"
        body = escape(text)
        if role == LEARNT:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; ValueError for any other text."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]).replace("%0A", "\n").replace("%25", "%"), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def _keyed(messages: DataFrame) -> DataFrame:
    """With c, the conversation as text: null is one too."""
    return messages.withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))


def paths(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, msg_id, parent_id, ...)`` -> ``(c, leaf, up, node)``: for
    each leaf the messages on its path, ``up`` steps above it.  A message whose
    parent is null or not in its conversation is a root.  Messages that lead
    round in a circle have no root and are on no path."""
    m = _keyed(messages).select("c", F.col("msg_id").alias("node"), F.col("parent_id").alias("parent"))
    m = m.where("node is not null")
    known = m.select(F.col("c").alias("kc"), F.col("node").alias("kn"))
    step = materialize(
        m.join(known, (m["c"] == known["kc"]) & (m["parent"] == known["kn"])).select("c", "node", F.col("parent").alias("to")), "parents"
    )
    leaves = m.join(step.select(F.col("c").alias("pc"), F.col("to").alias("pt")).distinct(), (F.col("c") == F.col("pc")) & (F.col("node") == F.col("pt")), "left_anti").select("c", "node")
    most = m.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    steps: list[DataFrame] = []
    while not step.isEmpty():
        steps.append(step)
        if 2 ** (len(steps) - 1) > most:  # only what leads round in a circle gets so far
            lost = step.select(F.col("c").alias("xc"), F.col("node").alias("xn"))
            leaves = leaves.join(lost, (F.col("c") == F.col("xc")) & (F.col("node") == F.col("xn")), "left_anti")
            steps.pop()
            break
        twice = step.select(F.col("c").alias("dc"), F.col("node").alias("dn"), F.col("to").alias("dt"))
        step = materialize(
            step.join(twice, (step["c"] == twice["dc"]) & (step["to"] == twice["dn"])).select("c", "node", F.col("dt").alias("to")), "steps"
        )
    found = leaves.select("c", F.col("node").alias("leaf"), F.lit(0).alias("up"), "node")
    for k in range(len(steps) - 1, -1, -1):
        jump = steps[k].select(F.col("c").alias("jc"), F.col("node").alias("jn"), "to")
        here = F.struct(F.col("up").alias("up"), F.col("node").alias("node"))
        there = F.struct((F.col("up") + 2**k).alias("up"), F.col("to").alias("node"))
        found = found.join(jump, (found["c"] == jump["jc"]) & (found["node"] == jump["jn"]), "left").select(
            "c", "leaf", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x")
        )
        found = found.select("c", "leaf", "x.up", "x.node")
    return found


def format_trees(messages: DataFrame, keep: int | None = 1, unique: bool = False) -> DataFrame:
    """``messages(conv_id, msg_id, parent_id, role, text, score)`` ->
    ``(conv_id, leaf_id, branch_rank, branch_score, n_turns, formatted,
    loss_spans)``: the ``keep`` best branches of each conversation (None: all).

    A branch's score is the mean of its messages' scores (null: 0); ties go to
    the longer branch, then to the smaller leaf.  Null roles and texts count as
    empty; a null conv_id is a conversation of its own; null msg_ids take no part.
    Of rows that repeat a conversation's msg_id the least (by parent, role, text, score)
    counts; ``unique`` says that none does, which saves a shuffle.  An empty table gives
    no rows; further columns are ignored."""
    if not unique:
        row = F.struct("parent_id", "role", "text", "score")
        messages = materialize(messages.where("msg_id is not null").groupBy("conv_id", "msg_id").agg(F.min(row).alias("row")).select("conv_id", "msg_id", "row.*"), "messages")
    found = paths(messages)
    every = _keyed(messages).select(
        F.col("c").alias("mc"), F.col("msg_id").alias("mn"), "conv_id",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    if keep is not None:
        scored = found.join(every.select("mc", "mn", "score"), (found["c"] == F.col("mc")) & (found["node"] == F.col("mn")))
        sums = scored.groupBy("c", "leaf").agg(F.avg("score").alias("s"), F.count("*").alias("n"))
        best = W.partitionBy("c").orderBy(F.desc("s"), F.desc("n"), "leaf")
        chosen = sums.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep).select(F.col("c").alias("rc"), F.col("leaf").alias("rl"), "r")
        found = found.join(chosen, (found["c"] == F.col("rc")) & (found["leaf"] == F.col("rl"))).select("c", "leaf", "up", "node", "r")
    rows = found.join(every, (found["c"] == every["mc"]) & (found["node"] == every["mn"]))
    chats = rows.groupBy("c", "leaf").agg(
        F.first("conv_id").alias("conv_id"), F.avg("score").alias("s"), F.count("*").alias("n"),
        (F.first("r") if keep is not None else F.lit(None)).cast("int").alias("r"),
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"),
    )
    if keep is None:
        chats = chats.withColumn("r", F.row_number().over(W.partitionBy("c").orderBy(F.desc("s"), F.desc("n"), "leaf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "leaf_id", "branch_rank", "branch_score", "n_turns", "formatted", "loss_spans"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                made = [render([(t["role"], t["text"]) for t in turns.as_py()]) for turns in part.column(5)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(5)),
                        pa.array([f for f, _ in made], pa.string()),
                        pa.array([[{"start": s, "end": e} for s, e in spans] for _, spans in made], span),
                    ],
                    names,
                )

    types = {n: messages.schema[n].dataType.simpleString() for n in ("conv_id", "msg_id")}
    return chats.select("conv_id", "leaf", "r", "s", "n", "turns").mapInArrow(
        run,
        f"conv_id {types['conv_id']}, leaf_id {types['msg_id']}, branch_rank int, branch_score double, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>",
    )


def linear_messages(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` rows as trees without branches: a message's
    parent is the one before it by turn (ties by role, then text; nulls first)."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = turns.select("conv_id", "role", "text", F.row_number().over(w).alias("msg_id"))
    return n.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def read_back(chats: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars)`` from ``(conv_id, formatted, loss_spans)`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                text = text.as_py()
                turns = parse(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans.as_py())
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), sha, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
