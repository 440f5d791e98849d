"""Chat formatting with prefix-target expansion.

Every turn is written between control strings; control strings inside roles and texts are escaped so that reading gives them back. Each assistant turn
becomes an example of its own (``examples``): its context is the text of everything of its conversation before it, and only its reply is trainable.
Written out, examples grow with the square of a conversation's turns, as the method has it: they leave their task one by one, a conversation of many replies
is written by many tasks, and ``digests``, which reads every example whole, passes on only what each adds to the one before.

Places in a conversation are running sums formed in slices of turns, so that one conversation may hold a third of all turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
SLICE = 1000
#: Examples of one conversation that one task writes; each such block is sent the turns before it.
BLOCK = 64
#: Code points and rows after which a task passes on the examples it has written.
WRITTEN, ROWS = 4_000_000, 1000
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: Column) -> Column:
    """Backslashes doubled and every ``<|`` parted by one, so no control string is left in it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id``, ``turn``, ``formatted``, ``start`` (code points of its conversation before it), ``n_chars``, and, for a reply,
    ``example`` (from 0), ``context_end`` (its context are all code points before), ``loss_start``, ``loss_end`` (its text in the written conversation).
    ``replies_before`` are the replies before the turn, which is the first example that it is part of; ``conv_replies`` and ``conv_chars`` those and the code points
    of its conversation. ``examples`` writes the examples out.

    Turns follow each other by ``turn``, ties by role and text, nulls first. Null roles and texts are empty; a null ``conv_id`` is a
    conversation. Repeated rows are turns each. Other columns are ignored."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(text)
    rows = turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(head, body, F.lit(f"{END}\n")).alias("formatted"),
        F.length(head).alias("head"),
        F.length(body).alias("body"),
        (role == TRAINED).cast("int").alias("reply"),
        F.floor(F.col("turn") / SLICE).alias("slice"),
    ).withColumn("n_chars", F.length("formatted").cast("long"))
    totals = rows.groupBy("conv_id", "slice").agg(F.sum("n_chars").alias("chars"), F.sum("reply").alias("replies"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    before = totals.select(
        F.col("conv_id").alias("_conv"),
        F.col("slice").alias("_slice"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("replies").over(earlier), F.lit(0)).alias("replies_before"),
        F.sum("chars").over(every).alias("conv_chars"),
        F.sum("replies").over(every).alias("conv_replies"),
    )
    rows = rows.join(before, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("slice").eqNullSafe(F.col("_slice")))
    own = Window.partitionBy("conv_id", "slice").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("chars_before") + F.sum("n_chars").over(own) - F.col("n_chars")
    rows = rows.withColumn("start", start).withColumn("replies", F.col("replies_before") + F.sum("reply").over(own))
    reply = F.col("reply") == 1
    return rows.select(
        "conv_id",
        "turn",
        "formatted",
        "start",
        "n_chars",
        F.when(reply, F.col("replies") - 1).alias("example"),
        F.when(reply, F.col("start") + F.col("head")).alias("context_end"),
        F.when(reply, F.col("start") + F.col("head")).alias("loss_start"),
        F.when(reply, F.col("start") + F.col("head") + F.col("body")).alias("loss_end"),
        (F.col("replies") - F.col("reply")).alias("replies_before"),
        "conv_replies",
        "conv_chars",
    )


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An example for each reply of a block, whose conversation's turns come one after the other from the first on, and what follows the last reply."""
    out: list[tuple] = []
    size, kind, key, context, since, chars = 0, None, None, [], 0, 0

    def rows() -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["conv_id", "example", "text", "since", "loss_start", "loss_end"]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    for batch in batches:
        kind = batch.column("conv_id").type
        for r in batch.to_pylist():
            if key != (r["conv_id"], r["block"]):
                key, context, since, chars = (r["conv_id"], r["block"]), [], 0, 0
            context.append(r["formatted"])
            chars += len(r["formatted"])
            if r["first"] == r["block"] and (r["example"] is not None or r["last"]):
                context = ["".join(context)]
                out.append((r["conv_id"], r["example"], context[0], since, r["loss_start"], r["loss_end"]))
                size += chars
            if r["example"] is not None:
                since = chars
            if size >= WRITTEN or len(out) >= ROWS:
                yield rows()
                out, size = [], 0
    if out:
        yield rows()


def examples(written: DataFrame) -> DataFrame:
    """``conv_id``, ``example``, ``text`` (context and reply, written out), ``since`` (code points of the example before, which the text begins with), ``loss_start``,
    ``loss_end``: one row per reply, and one without ``example`` and loss for a conversation that does not end with a reply, whose text is all of it.

    The size grows with the square of a conversation's turns. A task holds the text of one conversation and the few million code points that it passes on
    at a time; a conversation of more than ``BLOCK`` replies is written by several tasks."""
    kind = dict(written.dtypes)["conv_id"]
    # What follows the last reply is written beside it; a conversation without replies has one block.
    blocks = F.floor(F.greatest(F.col("conv_replies") - 1, F.lit(0)) / BLOCK)
    first = F.least(F.floor(F.col("replies_before") / BLOCK), blocks)
    rows = written.select(
        "conv_id",
        F.explode(F.sequence(first, blocks)).alias("block"),
        "start",
        "formatted",
        first.alias("first"),
        "example",
        "loss_start",
        "loss_end",
        (F.col("start") + F.col("n_chars") == F.col("conv_chars")).alias("last"),
    )
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "start")
    return rows.mapInArrow(_expand, f"conv_id {kind}, example long, text string, since long, loss_start long, loss_end long")


def example_texts(written: DataFrame) -> DataFrame:
    """``conv_id``, ``example``, ``text`` (context and reply), ``loss_start``, ``loss_end``: the examples alone."""
    return examples(written).filter("example IS NOT NULL").select("conv_id", "example", "text", "loss_start", "loss_end")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose examples come one after the other, over any number of batches."""
    state: dict | None = None

    def row() -> pa.RecordBatch:
        values = {
            "conv_id": pa.array([state["id"]], state["kind"]),
            "n_turns": pa.array([state["turns"]], pa.int64()),
            "turns_sha256": [state["all"].hexdigest()],
            "loss_chars": pa.array([state["loss_chars"]], pa.int64()),
            "loss_sha256": [state["loss"].hexdigest()],
            "formatted_chars": pa.array([state["chars"]], pa.int64()),
            "n_examples": pa.array([state["examples"]], pa.int64()),
        }
        return pa.record_batch(values)

    for batch in batches:
        kind = batch.column("conv_id").type
        for r in batch.to_pylist():
            if state is None or r["conv_id"] != state["id"]:
                if state is not None:
                    yield row()
                state = {"id": r["conv_id"], "kind": kind, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "examples": 0, "whole": None}
            # The text begins with the whole example before it.
            if r["since"] != state["chars"] or state["whole"] not in (None, r["begins"]):
                raise ValueError(f"an example of conversation {r['conv_id']} does not continue the one before it")
            added, at = r["added"], 0
            while at < len(added):
                turn = _TURN.match(added, at)
                state["turns"] += 1
                state["all"].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                begins, at = turn.start(2), turn.end()
            if r["example"] is not None:
                # All before the reply is context, the reply's own head included; the example ends with its turn.
                if r["example"] != state["examples"] or r["loss_start"] != r["since"] + begins:
                    raise ValueError(f"example {r['example']} of conversation {r['conv_id']} does not end with its reply")
                reply = unescape(r["reply"])
                state["loss"].update(reply.encode())
                state["loss_chars"] += len(reply)
                state["examples"] += 1
            state["chars"] += len(added)
            state["whole"] = r["whole"]
    if state is not None:
        yield row()


def digests(written: DataFrame) -> DataFrame:
    """What reading the written examples gives back, one row per conversation. Every example is read whole where it is written: its reply under the loss mask,
    what it adds to the example before it, and hashes that show that it begins with that one. A digest of a conversation has to see its turns in
    order, so these, which hold each turn once, stream through one task, one batch at a time."""
    kind = dict(written.dtypes)["conv_id"]
    rows = examples(written).selectExpr(
        "conv_id",
        "example",
        "since",
        "loss_start",
        "substring(text, CAST(since + 1 AS int)) AS added",
        "substring(text, CAST(loss_start + 1 AS int), CAST(loss_end - loss_start AS int)) AS reply",
        "xxhash64(substring(text, 1, CAST(since AS int))) AS begins",
        "xxhash64(text) AS whole",
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "since").mapInArrow(
        _read,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long",
    )
