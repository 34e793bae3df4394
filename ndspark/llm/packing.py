"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only the histogram of piece lengths, one number per length, reaches the driver. There a
configuration linear program over it is solved by multiplicative weights: a knapsack dynamic
program prices the best patterns of lengths under the current weights, and what these cover loses weight.
Rounding down keeps whole patterns, best-fit decreasing packs only what that leaves, and both work on counts, so
that their time doesn't grow with the number of documents. Pieces then find their places by rank within their length.

A null text is an empty one: a single end token. Longer documents than a sequence are cut into
whole sequences, the first piece taking the remainder. Repeated rows are packed each. An empty
table has no sequences. Null ids are carried through.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions, slices

SEQUENCE, END_ID = 1024, 2
#: Rounds of pricing at most, patterns that one round uses, and how much worse than the best these may be.
ROUNDS, PATTERNS, SLACK = 400, 8, 0.002
#: The share of what the scarcest length has left that one use takes, the rate of the weights, and the power of a
#: length that they start from (long pieces fit worst).
STEP, RATE, POWER = 0.5, 0.5, 1.1

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


@lru_cache(2)
def tokenizer(json_path: str, ranks_path: str | None, pattern: str):  # noqa: ANN201
    """Encodes texts to arrays of ids as the tokenizers library does by json_path, one per Python worker.

    With ranks_path, the same vocabulary as ranks, texts go the quicker way through tiktoken, except
    those that hold the file's special token."""
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(json_path)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    slow = lambda text: np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)
    if not ranks_path:
        return slow
    import tiktoken

    from .bpe import read_ranks

    quick = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
    return lambda text: slow(text) if any(s in text for s in special) else quick.encode_to_numpy(text, disallowed_special=())


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut where too long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(json_path, ranks_path, pattern)
        for b in slices(batches):
            at, rows = [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % size or size
                ends = range(first, len(ids) + 1, size)
                at += [k] * len(ends)
                rows += [(i, max(0, e - size) if i else 0, size if i else first, zlib.crc32(ids[max(0, e - size) if i else 0 : e].tobytes())) for i, e in enumerate(ends)]
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Knapsack:
    """Patterns of most weight by dynamic programming: for every room the best filling, any length any number of times."""

    def __init__(self, weights: np.ndarray, lengths: np.ndarray, size: int):
        self.weights, self.lengths, self.size = weights, lengths, size
        self.best, self.take = np.zeros(size + 1), np.full(size + 1, -1)
        for room in range(int(lengths[0]), size + 1):
            n = np.searchsorted(lengths, room, "right")
            gain = weights[:n] + self.best[room - lengths[:n]]
            k = int(gain.argmax())
            self.best[room], self.take[room] = (gain[k], k) if gain[k] > self.best[room - 1] else (self.best[room - 1], -1)

    def near_best(self) -> np.ndarray:
        """The lengths (as places) that begin a pattern nearly as good as the best."""
        return np.flatnonzero(self.weights + self.best[self.size - self.lengths] >= (1 - SLACK) * self.best[self.size])

    def pattern(self, first: int) -> Pattern:
        found, room = Counter({int(self.lengths[first]): 1}), self.size - int(self.lengths[first])
        while room > 0:
            if self.take[room] < 0:
                room -= 1
            else:
                found[int(self.lengths[self.take[room]])] += 1
                room -= int(self.lengths[self.take[room]])
        return tuple(sorted(found.items(), reverse=True))


def fractional(counts: dict[int, int], size: int, rounds: int = ROUNDS) -> tuple[dict[Pattern, float], float]:
    """Multiplicative weights for the covering program: how often to use which pattern, as fractions, and a lower bound of any solution.

    Every length has a weight. A round prices patterns by them: the best, and some nearly as good that begin with what is
    most open, are used, and each weight in them is multiplied by exp(-RATE * the share of its demand that this covers). A use takes STEP of
    what the pattern's scarcest length has left, or all of it once that is less than one sequence; no length is covered
    beyond its demand. Weights over their best pattern are a feasible dual, which gives the bound: at the start with
    lengths as weights, then with those of each round that prices all lengths."""
    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths.tolist()], float)
    where = {int(x): k for k, x in enumerate(lengths)}
    bound = float(need @ lengths) / Knapsack(lengths.astype(float), lengths, size).best[size]
    weights, left, used = lengths.astype(float) ** POWER, need.copy(), {}
    for _ in range(rounds):
        open_ = np.flatnonzero(left > 1e-9)
        if not len(open_):
            break
        sack = Knapsack(weights[open_], lengths[open_], size)
        if len(open_) == len(lengths):
            bound = max(bound, float(need @ weights) / sack.best[size])
        share, able = (left / need)[open_], sack.near_best()
        for first in able[np.argsort(-share[able], kind="stable")][:PATTERNS].tolist():
            pattern = sack.pattern(first)
            at, many = np.array([where[x] for x, _ in pattern]), np.array([m for _, m in pattern], float)
            most = float((left[at] / many).min())
            if most > 1e-9:
                x = most if most <= 1 else max(1.0, STEP * most)
                used[pattern] = used.get(pattern, 0.0) + x
                left[at] -= x * many
                weights[at] *= np.exp(-RATE * x * many / need[at])
    return used, bound


def best_fit(counts: dict[int, int], size: int, begun: Counter[Pattern] | None = None) -> Counter[Pattern]:
    """Best-fit decreasing on counts, into the sequences that are begun and new ones; sequences with
    equal contents are handled as one group."""
    rooms: dict[int, Counter[tuple[int, ...]]] = {}
    heap_of_rooms: list[int] = []
    done: Counter[Pattern] = Counter()

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = Counter()
        rooms[room][content] += n

    for pattern, n in (begun or {}).items():
        put(size - sum(x * m for x, m in pattern), tuple(x for x, m in pattern for _ in range(m)), n)
    smallest = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        heap_of_rooms = [r for r in rooms if r >= length and rooms[r]]
        heapq.heapify(heap_of_rooms)
        while left and heap_of_rooms:
            room = heap_of_rooms[0]
            if not rooms[room]:
                heapq.heappop(heap_of_rooms)
                continue
            content, n = next(iter(rooms[room].items()))
            now = min(n, left)
            rooms[room][content] -= now
            if not rooms[room][content]:
                del rooms[room][content]
            rest = room - length
            if rest >= length and rest not in heap_of_rooms:
                heapq.heappush(heap_of_rooms, rest)
            put(rest, (*content, length), now)
            left -= now
        while left:
            each = min(size // length, left)
            n = left // each
            put(size - each * length, (length,) * each, n)
            left -= n * each
        for room in [r for r in rooms if r < smallest]:
            for content, n in rooms.pop(room).items():
                done[tuple(sorted(Counter(content).items(), reverse=True))] += n
    for contents in rooms.values():
        for content, n in contents.items():
            done[tuple(sorted(Counter(content).items(), reverse=True))] += n
    return done


def plan(counts: dict[int, int], size: int = SEQUENCE) -> Counter[Pattern]:
    """Patterns and how often to use each, covering counts exactly: the program's, rounded down; what that
    leaves is packed by best fit into their room and new sequences."""
    counts = {x: n for x, n in counts.items() if n}
    left, begun = dict(counts), Counter()
    short = {x: n for x, n in counts.items() if x < size}
    for pattern, x in sorted(fractional(short, size)[0].items(), key=lambda p: (-p[1], p[0])) if short else ():
        n = min([int(x + 1e-9), *(left[k] // m for k, m in pattern)])
        if n > 0:
            begun[pattern] += n
            for k, m in pattern:
                left[k] -= n * m
    return best_fit({x: n for x, n in left.items() if n}, size, begun)


def places(patterns: Counter[Pattern]) -> pd.DataFrame:
    """For each length and pattern: the first rank it takes, the first sequence, how many in each, the offset."""
    rows, taken, sequence = [], Counter(), 0
    for pattern, n in sorted(patterns.items(), reverse=True):
        offset = 0
        for length, many in pattern:
            rows.append((length, taken[length], sequence, many, offset))
            taken[length] += n * many
            offset += length * many
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "many", "offset"], dtype="int64").sort_values(["length", "first"])


def pack(cut_pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """cut_pieces with sequence_id and offset. The rank of a piece within its length comes from counts by
    (length, bucket) and a numbering inside each bucket, so that a very common length, or row, is spread."""
    spark = cut_pieces.sparkSession
    rows = cut(cut_pieces)
    # as the input grows a bucket keeps its size; a row's place in what was cut parts it from its copies
    spot = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())
    bucketed = rows.withColumn("bucket", F.pmod(spot, F.lit(4 * partitions(spark))).cast("int"))
    by_bucket = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = by_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` lengths
    table = places(plan(counts, size))
    starts = (table["length"].to_numpy() << 44) + table["first"].to_numpy()
    length, first, sequence, many, offset = (table[k].to_numpy() for k in ("length", "first", "sequence", "many", "offset"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(of: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(starts, (of.to_numpy() << 44) + rank.to_numpy(), "right") - 1
        inside = rank.to_numpy() - first[k]
        return pd.DataFrame({"sequence_id": sequence[k] + inside // many[k], "offset": offset[k] + inside % many[k] * length[k]})

    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = bucketed.withColumn("number", number).join(before, ["length", "bucket"]).withColumn("at", place("length", F.col("before") + F.col("number")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
