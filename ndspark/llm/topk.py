"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

Vectors are dealt into blocks. A block is kept as its lists alone: one per dimension, of (row, value) in ascending
order of the values. For a block of queries the lists are read one stretch after the other, from the end that the query's
weight favours. What has been read of a candidate is summed up; a component that hasn't been read yet lies between the
value that reading has reached and the list's far end, which gives every candidate an upper and a lower
bound. Once few candidates of a query can still reach its k-th lower bound, all others are out; the
scores of these few are resolved by reading on for them alone. Nobody's vector is looked up. Where the bounds can't part
the candidates, the lists are read to the end, where both bounds meet. Each block gives its own k best, and the
best of these are the result.

Sums are exact whole numbers: in floats where these hold all sums exactly, else in 64-bit or Python integers. A score
beyond a long counts as the nearest long, before it is ranked; so does a product of component and scale beyond a double.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id;
shorter vectors count as filled with zeros. Vectors of similar length share blocks, so that a very long one
pads no others. Ties go to the smaller id; rows with the query's own id are never its answers. An empty table gives
an empty result, empty vectors scores of 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices

#: Components in a block of candidates and of queries; vectors at most (their rows fit 16 bits).
BLOCK, QUERY_BLOCK, MOST = 2**19, 2**16, 2**14
#: Shares of the lists between two looks at the bounds; candidates that a query resolves by itself.
DEPTHS, RESOLVE = (0.25, 0.5, 0.75, 0.875, 1.0), 256
#: Types of sums, the size up to which they hold whole numbers exactly, and queries that are answered at once.
TYPES = ((np.float32, 2**23, 1024), (np.float64, 2**52, 512), (np.int64, 2**62, 256), (object, None, 16))
LONG = -(2**63), 2**63 - 1


def whole(values: np.ndarray, as_type: type) -> np.ndarray:
    """Whole numbers that come as integers or doubles, exact in the type that their sums need."""
    return np.frompyfunc(int, 1, 1)(values) if as_type is object else values.astype(as_type)


class Lists:
    """The sorted lists of a block: rows and values, to be read from either end. No way leads from a row to its vector."""

    def __init__(self, rows: np.ndarray, values: np.ndarray):
        self.rows, self.values, self.n = rows.astype(np.int64), values, len(rows)

    def read(self, since: int, until: int, top: bool) -> np.ndarray:
        """What stands at the places since to until from an end, put where it belongs; zero elsewhere."""
        out = np.zeros_like(self.values)
        part = slice(self.n - until, self.n - since) if top else slice(since, until)
        np.put_along_axis(out, self.rows[part], self.values[part], 0)
        return out

    def unread(self, until: int, top: bool, value: np.ndarray) -> np.ndarray:
        """value of a list where a row hasn't come up in it yet; zero elsewhere."""
        out = np.zeros_like(self.values)
        part = self.rows[: self.n - until] if top else self.rows[until:]
        np.put_along_axis(out, part, np.broadcast_to(value, part.shape), 0)
        return out

    def at(self, depth: int, top: bool) -> np.ndarray:
        """The values that reading has reached."""
        return self.values[self.n - depth if top else depth - 1]


def best_of_block(ids: np.ndarray, lists: Lists, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Columns query, id, score and depth of the k best of this block for every query; depth is the share of the lists
    that was read to part the candidates."""
    n, exact, out, since = lists.n, lists.values.dtype, [], 0
    ends = (True, np.maximum(q, 0)), (False, np.minimum(q, 0))
    lowest = -np.inf if exact.kind == "f" else LONG[0]
    as_long = (lambda x: np.clip(x, *LONG)) if exact == object else lambda x: x
    depths = sorted({max(1, int(n * share)) for share in DEPTHS})
    open_, seen = np.arange(len(q)), np.zeros((len(q), n), exact)
    for step, depth in enumerate(depths):
        seen = seen + sum(w[open_] @ lists.read(since, depth, top).T for top, w in ends)
        upper = lower = as_long(seen)
        if depth < n:
            upper = as_long(seen + sum(w[open_] @ lists.unread(depth, top, lists.at(depth, top)).T for top, w in ends))
            lower = as_long(seen + sum(w[open_] @ lists.unread(depth, top, lists.at(n, top)).T for top, w in ends))
        others = query_ids[open_, None] != ids[None, :]
        ranked = np.where(others, lower, lowest)
        kth = (np.sort(ranked, 1) if exact == object else np.partition(ranked, n - k, 1))[:, n - k, None] if n > k else lowest
        able = others & (upper >= kth)
        done = np.full(len(open_), depth == n) | (able.sum(1) <= max(RESOLVE, k))
        r, c = np.nonzero(able[done])
        which, score = open_[done][r], seen[done][r, c]
        for begin, end in zip(depths[step:], depths[step + 1 :], strict=False):
            if len(r):  # reading on for these alone
                score = score + sum((w[which] * lists.read(begin, end, top)[c]).sum(1) for top, w in ends)
        score = as_long(score).astype(np.int64)
        order = np.lexsort((ids[c], ~score, which))
        which, c, score = which[order], c[order], score[order]
        keep = np.arange(len(which)) - np.searchsorted(which, which) < k
        out.append((query_ids[which[keep]], ids[c[keep]], score[keep], np.full(keep.sum(), depth / n)))
        open_, seen, since = open_[~done], seen[~done], depth
        if not len(open_):
            break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed(vectors: DataFrame, sizes: dict[int, int], most: int, components: int, name: str, scale: float, as_lists: bool) -> DataFrame:
    """(name, ids, rows, values, large): blocks of vectors as whole numbers in bytes, as sorted lists or as they are.

    sizes: the number of vectors by power of two of their length."""
    per = {c: max(1, min(most, components >> c)) for c in sizes}
    blocks = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // per[c]))])
    # equal rows, however many, are dealt by the part of the table that they stand in
    block = (F.shiftleft(F.col("c").cast("long"), 40) + F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), blocks[F.col("c")])).alias(name)

    def block_of(key: int, ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        width = max(map(len, vectors))
        values = np.zeros((len(vectors), width))
        for k, v in enumerate(vectors):
            values[k, : len(v)] = v
        with np.errstate(over="ignore"):
            values = np.nan_to_num(np.floor(values * scale))
        large = bool((np.abs(values) >= 2**31).any())
        values, rows = values if large else values.astype(np.int32), np.zeros(0, np.uint16)
        if as_lists:
            rows = np.argsort(values, 0, kind="stable").astype(np.uint16)
            values = np.take_along_axis(values, rows.astype(np.int64), 0)
        cols = pa.array([key], pa.int64()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (np.array(ids, np.int64), rows, values)), pa.array([large])
        return pa.RecordBatch.from_arrays([*cols], [name, f"{name}_ids", f"{name}_rows", f"{name}_values", f"{name}_large"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, [], []
        for b in slices(batches):
            v = b.column("v")
            flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            for k, (key, of) in enumerate(zip(b.column(name).to_pylist(), b.column("id").to_pylist(), strict=True)):
                if held and (key != at or len(held) == per[key >> 40]):
                    yield block_of(at, ids, held)
                    ids, held = [], []
                at = key
                ids.append(of)
                held.append(np.array(flat[ends[k] : ends[k + 1]], float))
        if held:
            yield block_of(at, ids, held)

    dealt = vectors.select("id", "v", block)
    return dealt.repartition(name).sortWithinPartitions(name).mapInArrow(run, f"{name} long, {name}_ids binary, {name}_rows binary, {name}_values binary, {name}_large boolean")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, depth): the k best rows of vectors for every row that `queries` is true of, by the
    inner product of floor(scale * component). depth: the largest share of a block's lists that parted the query's candidates.

    Queries and candidates meet block by block; no side is collected or broadcast."""
    sound = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = vectors.where(sound & F.col(id_col).isNotNull())
    length = F.greatest(F.size(vector_col), F.lit(1))
    both = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"), F.ceil(F.log2(length)).cast("int").alias("c"))
    found = both.groupBy("c").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).collect()  # at most 31 rows
    sizes, asks = {r.c: r.n for r in found} or {0: 0}, {r.c: r.asks for r in found if r.asks} or {0: 0}
    candidates = packed(both, sizes, MOST, BLOCK, "block", scale, True)
    n_blocks = {c: -(-n // max(1, min(MOST, BLOCK >> c))) for c, n in sizes.items()}
    every = [F.sequence(F.lit(c << 40), F.lit((c << 40) + n - 1)) for c, n in n_blocks.items() if n] or [F.array().cast("array<long>")]
    asked = packed(both.where("asks"), asks, TYPES[0][2], QUERY_BLOCK, "query", scale, False).withColumn("block", F.explode(F.flatten(F.array(*every))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, query_ids = (np.frombuffer(r[f"{x}_ids"], np.int64) for x in ("block", "query"))
                x, q = (np.frombuffer(r[f"{x}_values"], float if r[f"{x}_large"] else np.int32).reshape(len(i), -1) for x, i in (("block", ids), ("query", query_ids)))
                width = min(x.shape[1], q.shape[1])  # beyond, one of both is zero
                order, x, q = np.frombuffer(r["block_rows"], np.uint16).reshape(len(ids), -1)[:, :width], x[:, :width], q[:, :width]
                largest = width * int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0))
                exact, _, many = next(t for t in TYPES if t[1] is None or largest < t[1])
                lists, q = Lists(order, whole(x, exact)), whole(q, exact)
                for at in range(0, len(q), many):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, best_of_block(ids, lists, query_ids[at : at + many], q[at : at + many], k))], ["query_id", "vec_id", "score", "depth"])

    best = candidates.join(asked, "block").mapInArrow(run, "query_id long, vec_id long, score long, depth double")
    of_query = Window.partitionBy("query_id")
    best = best.withColumn("rank", F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.max("depth").over(of_query).alias("depth"))
