"""Chat formatting of reply trees.

Messages point to the message that they answer. Iterated self-joins double the distance that each
pointer spans, so that a thread of n messages takes log2(n) joins; they give every message its depth
and the score of its branch. The best branches of each tree are chosen among its leaves, and the same
pointers, from the leaf on, give the messages of each chosen path: as many rows as it is long.

A path is formatted turn by turn with control strings; those that occur in a text are escaped, so that
the output can be read back exactly. The loss mask covers the texts of the assistant.

Null roles and texts are empty. A message whose parent isn't there begins a tree; messages in a
circle belong to no path. Ties go to the smaller message. Turns of one number in a conversation
are ordered by role, then text; repeated rows are turns of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import cut, slices

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.S)


def threads(turns: DataFrame) -> DataFrame:
    """Messages (tree, node, parent, score, role, text) of conversations without branches: each turn
    answers the one before it."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    rows = turns.select(F.col("conv_id").alias("tree"), place.cast("long").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def same(a: str, b: str, *on: tuple[str, str]) -> Column:
    """Equality of trees, nulls included, and of the given columns."""
    out = F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    for x, y in on:
        out = out & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    return out


def branches(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, total, leaf) of the messages that reach a root, and the pointers (tree, node, up)
    that span 1, 2, 4 ... messages."""
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", "node")
    there = nodes.alias("n").join(known.alias("p"), same("n", "p", ("parent", "node")), "left")
    state = cut(there.select("n.tree", "n.node", F.col("p.node").alias("up"), F.lit(1).alias("depth"), F.col("n.score").alias("total")))
    parents = state.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    hops: list[DataFrame] = []
    most = state.count()
    while 2 ** len(hops) <= 2 * most and not state.where("up is not null").isEmpty():
        active = state.where("up is not null")  # the others have reached their root
        hops.append(active.select("tree", "node", "up"))
        far = active.alias("s").join(state.alias("u"), same("s", "u", ("up", "node")))
        moved = far.select("s.tree", "s.node", "u.up", (F.col("s.depth") + F.col("u.depth")).alias("depth"), (F.col("s.total") + F.col("u.total")).alias("total"))
        state = cut(state.where("up is null").unionByName(moved))
    rooted = state.where("up is null").drop("up")
    with_leaf = rooted.alias("r").join(parents.alias("p"), same("r", "p", ("node", "node")), "left")
    return with_leaf.select("r.tree", "r.node", "r.depth", "r.total", F.col("p.node").isNull().alias("leaf")), hops


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, rank, place, node): the messages of each tree's `top` best branches, place from 0 at the root.

    A branch ranks by its mean score, then its length, then the smaller leaf."""
    reached, hops = branches(messages)
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    leaves = reached.where("leaf").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    on = leaves.select("tree", F.col("node").alias("path"), "rank", "depth", "node", F.lit(0).alias("back"))
    for k, hop in enumerate(hops):
        before = on.alias("o").join(hop.alias("h"), same("o", "h", ("node", "node"))).select("o.tree", "o.path", "o.rank", "o.depth", F.col("h.up").alias("node"), (F.col("o.back") + 2**k).alias("back"))
        on = cut(on.unionByName(before))
    return on.select("tree", "path", "rank", (F.col("depth") - 1 - F.col("back")).alias("place"), "node")


def escaped(text: Column | str) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for a, b in (("\\", "\\\\"), ("<|", "<\\|"), ("|>", "|\\>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def formatted(messages: DataFrame, paths: DataFrame, learns: str = "assistant") -> DataFrame:
    """(tree, path, place, chunk, loss_start, loss_end): the output of each turn; its chunks in order of place
    make the conversation. The mask is in code points of the chunk; empty where the role doesn't learn."""
    turn = paths.alias("p").join(messages.alias("m"), same("p", "m", ("node", "node"))).select("p.tree", "p.path", "p.place", "m.role", "m.text")
    head = F.concat(F.lit(START), F.replace(escaped("role"), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    body = escaped("text")
    start = F.char_length(head)
    return turn.select("tree", "path", "place", F.concat(head, body, F.lit(END + "\n")).alias("chunk"), start.alias("loss_start"), (start + F.when(F.col("role") == learns, F.char_length(body)).otherwise(0)).alias("loss_end"))


def conversations(chunks: DataFrame) -> DataFrame:
    """(tree, path, text): whole conversations, for those that fit into a row."""
    return chunks.groupBy("tree", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk"))), lambda c: c["chunk"]), "").alias("text"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_back(chunks: DataFrame) -> DataFrame:
    """What a reader of the output finds per conversation (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars). Chunks of a conversation stream through one task in order, one at a time."""

    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [to_arrow_type(chunks.schema["tree"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, out = None, None, []

        def flush() -> pa.RecordBatch:
            cols = [*zip(*out, strict=True)] or [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], fields)

        def close() -> None:
            if found:
                out.append((key[0], found[0], found[1].hexdigest(), found[2], found[3].hexdigest(), found[4]))

        for b in slices(batches, 256):
            for r in b.to_pylist():
                if found is None or key != (r["tree"], r["path"]):
                    close()
                    key, found = (r["tree"], r["path"]), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                chunk = r["chunk"]
                turns = TURN.findall(chunk)
                if sum(len(START) + len(END) + 2 + len(a) + len(t) for a, t in turns) != len(chunk):
                    raise ValueError("the output can't be read back")
                for role, text in turns:
                    found[0] += 1
                    found[1].update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
                loss = unescaped(chunk[r["loss_start"] : r["loss_end"]])
                found[2] += len(loss)
                found[3].update(loss.encode())
                found[4] += len(chunk)
            if len(out) >= 256:
                yield flush()
                out.clear()
        close()
        yield flush()

    rows = chunks.repartition("tree", "path").sortWithinPartitions("tree", "path", "place")
    return rows.mapInArrow(run, f"conv_id {chunks.schema['tree'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
